"""State along sessions that arrive in pieces, without a stream."""

import pyarrow as pa
from pyspark.sql import Row

from tallyhouse.streaming.state import LastValues, _edges


class Kept:
    """A value state that counts how often it is asked and written."""

    def __init__(self, value=None):
        self.value, self.calls = value, []

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


def entries(kept, chunks):
    sessions = LastValues(["model", "cwd"])
    sessions.state = kept
    chunk = Row("file", "start", "seq", "out_model", "out_cwd", "lines")
    return [tuple(r) for r in sessions.handleInputRows(("/s",), iter([chunk(*c) for c in chunks]), None)]


def test_a_session_asks_for_its_state_once():
    """Chunks in any order; a state call for each of many small sessions is what their stream takes time for."""
    kept = Kept()
    got = entries(kept, [("b", 0, 0, "m2", None, b"3"), ("a", 0, 1, None, "/w", b"2"), ("a", 0, 0, "m1", None, b"1")])
    assert got == [(b"1", None, None), (b"2", "m1", None), (b"3", "m1", "/w")]
    assert (kept.value, kept.calls) == (("m2", "/w"), ["get", "update"])
    assert entries(kept, [("c", 0, 0, None, None, b"4")]) == [(b"4", "m2", "/w")]
    assert kept.calls == ["get", "update", "get"]


def test_edges_of_runs_with_nulls():
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["a", "a", None, None, "b"]), pa.array([0, 1, 1, 1, 1])], names=["path", "start"])
    assert _edges(batch, ["path", "start"]) == [0, 1, 2, 4, 5]
    assert _edges(batch.slice(0, 1), ["path"]) == [0, 1] and _edges(batch.slice(0, 0), ["path"]) == [0]
