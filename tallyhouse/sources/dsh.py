"""DeepSeek Harness logs: session header, model and usage on separate lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse import constants as K
from tallyhouse.functions.identity import empty_to_null, event_key, parent_dir
from tallyhouse.operators.carry import carry_forward
from tallyhouse.operators.lookup import lookup_join
from tallyhouse.schemas import CACHE_READ, CACHE_WRITE, INPUT, OUTPUT, REASONING
from tallyhouse.session import cut_lineage
from tallyhouse.sources.events import as_events, parsed_json

_LINE = """type string, seq bigint, time bigint, id string, cwd string, data struct<model: string,
    header: struct<config: struct<model: string>>, usage: struct<inputTokens: bigint,
    outputTokens: bigint, cacheReadTokens: bigint, cacheWriteTokens: bigint,
    reasoningTokens: bigint>>"""
_PROJECTS = """tables struct<sessions: map<string, struct<identity: struct<cwd: string>>>>"""

STATE = {"session": "line_session", "cwd": "line_cwd", "model": "line_model"}


def dsh_states(lines: DataFrame) -> DataFrame:
    """Lines that set or use state, with what each of them sets."""
    j = F.col("j")
    header = j.type == "session"
    model = F.when(j.type == "request/context", j.data.model).when(
        j.type == "request/header", j.data.header.config.model
    )
    return (
        parsed_json(lines, _LINE)
        .where(j.type.isin("session", "request/context", "request/header", "assistant/message"))
        .select(
            "path", "block", "chunk", "pos",
            (j.type == "assistant/message").alias("answers"), j.seq.alias("seq"),
            j.time.alias("time"), j.data.usage.alias("usage"),
            empty_to_null(F.when(header, j.id)).alias("line_session"),
            empty_to_null(F.when(header, j.cwd)).alias("line_cwd"),
            empty_to_null(model).alias("line_model"),
        )
    )


def ffill_dsh_state(states: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """States with the session, folder and model in force."""
    return named_by_folder(carry_forward(states, STATE, None, initial))


def named_by_folder(states: DataFrame) -> DataFrame:
    """The session defaults to the folder that holds the file."""
    folder = F.element_at(F.split(parent_dir(F.col("path")), "/"), -1)
    return states.withColumn("session", F.coalesce("session", folder))


def project_folders(docs: DataFrame) -> DataFrame:
    """(session_id, project_cwd) of project cache documents."""
    sessions = F.from_json("value", _PROJECTS)["tables"]["sessions"]
    return (
        docs.select(F.explode(sessions).alias("session_id", "s"))
        .where(F.col("s.identity.cwd") != "")
        .select("session_id", F.col("s.identity.cwd").alias("project_cwd"))
    )


def with_session_cwd(events: DataFrame, folders: DataFrame) -> DataFrame:
    """Fill a missing project path from the session's known folder."""
    known = folders.groupBy("session_id").agg(F.max("project_cwd").alias("project_cwd"))
    return lookup_join(events, cut_lineage(known), "session_id").withColumn(
        "project_path", F.coalesce("project_path", "project_cwd")
    ).drop("project_cwd")


def dsh_events(states: DataFrame) -> DataFrame:
    usage = F.col("usage")
    rows = states.where(
        F.col("answers") & usage.isNotNull()
        & ((F.coalesce(usage.inputTokens, F.lit(0)) != 0)
           | (F.coalesce(usage.outputTokens, F.lit(0)) != 0))
    )
    names = {
        INPUT: "inputTokens", OUTPUT: "outputTokens", CACHE_READ: "cacheReadTokens",
        CACHE_WRITE: "cacheWriteTokens", REASONING: "reasoningTokens",
    }
    time = F.date_trunc("second", F.timestamp_millis(F.coalesce("time", F.lit(0))))
    key = event_key(F.lit("dsh"), F.col("session"), F.coalesce("seq", F.lit(0)), sep="::")
    return as_events(
        rows, K.DEEPSEEK_HARNESS, key, time, F.col("model"),
        {c: F.coalesce(usage[n], F.lit(0)) for c, n in names.items()},
        F.col("session"), F.col("cwd"),
    )


def parse_dsh_log(
    lines: DataFrame, folders: DataFrame | None = None, initial: DataFrame | None = None
) -> DataFrame:
    """Events of harness lines. The state lines are stored, so that the logs are parsed once."""
    events = dsh_events(ffill_dsh_state(cut_lineage(dsh_states(lines)), initial))
    return events if folders is None else with_session_cwd(events, folders)
