"""Model and provider names: normalisation, inference, price candidates."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse import constants as K


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r\x85\xa0"))


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def normalize_model(model: Column) -> Column:
    """Grouping name: lower case, without reasoning tier, date stamp or dotted version.

    One pattern takes both suffixes off, since this runs once per request.
    """
    tier = rf"\s*\(\s*(?:{'|'.join(K.REASONING_TIERS)})\s*\)"
    lower = trimmed(F.lower(model))
    name = F.when(lower != "", lower).otherwise("unknown")
    name = F.regexp_replace(name, rf"(?s)^(.+?)(?:-[0-9]{{8}})?(?:{tier})?$", "$1")
    return F.replace(name, F.lit("."), F.when(lower.contains("claude"), "-").otherwise("."))


def canonical_provider(provider: Column) -> Column:
    """First known alias among the "/" parts; unknown parts count only without digits."""
    parts = F.split(F.replace(F.lower(provider), F.lit("-"), F.lit("_")), "/")
    names = F.transform(
        F.filter(F.transform(parts, trimmed), lambda p: ~p.isin("", "unknown")),
        lambda p: F.coalesce(
            F.try_element_at(_lookup(K.PROVIDER_ALIASES), p), F.when(~p.rlike("[0-9]"), p)
        ),
    )
    return F.coalesce(F.try_element_at(F.filter(names, lambda p: p.isNotNull()), F.lit(1)), F.lit(""))


def infer_provider(model: Column, catalogue: bool = False) -> Column:
    """Provider guessed from keywords in a model name, '' when none fits."""
    lower = F.lower(model)
    guess = F.lit("")
    for words, provider in reversed(K.PROVIDER_KEYWORDS):
        if not (catalogue and provider in K.NOT_IN_CATALOGUE):
            hit = reduce(lambda a, b: a | b, [lower.contains(w) for w in words])
            guess = F.when(hit, provider).otherwise(guess)
    return guess


def dataset_prefix(provider: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(K.CATALOGUE_PREFIXES), provider), provider)


def version_sep(model: Column) -> Column:
    """Dotted form of single-digit versions ("4-5" -> "4.5"); NULL when nothing changes."""
    dotted = F.regexp_replace(model, r"(?<=(?<![0-9])[0-9])-(?=[0-9](?![0-9]))", ".")
    return F.when(dotted != model, dotted)


def bare_model(key: Column) -> Column:
    return F.element_at(F.split(trimmed(F.lower(key)), "/"), -1)


def comparable(model: Column) -> Column:
    lower = F.lower(model)
    return F.coalesce(version_sep(lower), lower)


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _no_names() -> Column:
    return F.array().cast("array<string>")


def _joined(parts: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(parts, first, count), "-")


def _counts(parts: Column, limit: int) -> Column:
    """1, 2, ... up to the limit, leaving at least one part; NULL for a single part."""
    most = F.least(F.size(parts) - 1, F.lit(limit))
    return F.when(F.size(parts) > 1, F.sequence(F.lit(1), most))


def dash_prefixes(model: Column) -> Column:
    """Every proper prefix that ends before a "-"."""
    return F.coalesce(_bound(F.split(model, "-"), lambda parts: F.transform(
        _counts(parts, 1 << 30), lambda n: _joined(parts, F.lit(1), n))), _no_names())


def _without_tails(parts: Column) -> Column:
    """Names without their last one to four parts, at least two characters long."""
    names = F.transform(_counts(parts, 4), lambda n: _joined(parts, F.lit(1), F.size(parts) - n))
    return F.coalesce(F.filter(names, lambda m: F.length(m) >= 2), _no_names())


def _without_heads(parts: Column) -> Column:
    """Names without their first or first two parts, each also without tails."""
    rests = F.transform(_counts(parts, 2), lambda n: F.slice(parts, n + 1, F.size(parts)))
    long_enough = F.filter(rests, lambda r: F.length(F.array_join(r, "-")) >= 2)
    names = F.transform(long_enough, lambda r: F.concat(
        F.array(F.array_join(r, "-")), _without_tails(r)))
    return F.coalesce(F.flatten(names), _no_names())


def _own_candidates(names: Column) -> Column:
    parts = F.transform(names, lambda n: F.split(n, "-"))
    own = F.concat(
        names, F.transform(names, version_sep),
        F.flatten(F.transform(parts, _without_tails)), F.flatten(F.transform(parts, _without_heads)),
    )
    return F.filter(own, lambda n: n != "")


def price_candidates(model: Column) -> Column:
    """Catalogue names to try for a model, in order and without repeats: its full and bare name,
    shortened forms of both, and all of them under the provider's catalogue prefix."""
    def prefixes(name: Column) -> Column:
        prefix = dataset_prefix(infer_provider(name, catalogue=True))
        return F.array(F.lit(""), F.when(prefix == "", "").otherwise(F.concat(prefix, F.lit("/"))))

    def candidates(name: Column) -> Column:
        own = _bound(F.array(name, bare_model(name)), _own_candidates)
        return F.flatten(_bound(own, lambda names: F.transform(
            prefixes(name), lambda p: F.transform(names, lambda n: F.concat(p, n)))))

    return F.array_distinct(_bound(trimmed(F.lower(model)), candidates))


def fuzzy_score(key: Column, model: Column) -> Column:
    """Preference among fuzzy price matches, higher is better."""
    lower = F.lower(key)
    vendor = F.element_at(F.split(model, "-"), 1)
    score = F.octet_length(key)
    score += F.when((vendor != "") & lower.startswith(F.concat(vendor, F.lit("/"))),
                    K.FUZZY_PROVIDER_BONUS).otherwise(0)
    for prefix, penalty in K.FUZZY_PENALTIES.items():
        score -= F.when(lower.startswith(prefix), penalty).otherwise(0)
    return score + F.when(lower.contains("/"), K.FUZZY_SLASH_BONUS).otherwise(0)
