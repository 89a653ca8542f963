"""Quality rules whose cutoffs are chosen with a bound on wrongly rejected documents.

A rule rejects texts in which some measure is above (or below) a cutoff.  The
cutoffs aren't set by hand: for each stratum (a language, say) and each rule, the
labelled good documents of that stratum give, for every cutoff of a fixed grid,
how many of them it would reject.  By an exact binomial test (the Clopper-Pearson
bound put as a test) the hypothesis that a cutoff rejects more than ``risk`` of
the good documents is refused or not.  Testing many cutoffs at once is paid for:
the error level ``delta`` is divided by strata x rules, and within a rule the
cutoffs are tested from the mildest on and the search stops at the first that
isn't refused (fixed-sequence testing), which needs no further share.  With
probability 1 - delta, the rules then reject, in every stratum, at most ``risk`` of
good documents like the labelled ones.  A stratum with too few labels gets no
cutoff, so it rejects nothing; with 4 strata and the settings below that takes at least
1232 labelled good documents (:func:`least_good`).

The counts cover every labelled row of every document, held out by nature: nothing
else is fitted on them.

Measures come from whole texts, on bytes and hashes of words: see ``COUNTS``.

Defined results: null and empty texts have no words, all counts zero, and fail the
base rule; null strata are a stratum of their own; rows with null or missing labels
aren't counted; repeated rows count as often as they occur; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store, _text

REPEAT_WORDS = 8
#: Symbols that prose has few of: a fixed set.
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_chars", "n_lines", "n_same_words", "n_marks")

#: Highest share of good documents that the rules may reject in a stratum, and the chance that any stratum breaks this.
RISK = 0.03
DELTA = 0.05
#: A good document that is rejected costs as much as so many bad ones that are kept (as shares of their kinds).
GOOD_COSTS = 5.0
#: Strata by this column; each needs enough labels of its own.
STRATUM = "lang"
#: Strata with cutoffs, of about 200 bytes each, that may be broadcast; beyond that rows and cutoffs are joined by shuffling, each stratum dealt into SALTS parts.
BROADCAST_STRATA, SALTS = 100_000, 64

_CLASS_SYMBOL = np.zeros(256, dtype=bool)
_CLASS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_LEADS = np.ones(256, dtype=bool)  # bytes that begin a code point
_LEADS[0x80:0xC0] = False
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[ord("!"), ord("?")]] = True


@dataclass(frozen=True)
class Rule:
    """Rejects where the measure is at least the cutoff.  ``grid`` goes from the mildest cutoff to the strictest."""

    name: str
    measure: str
    grid: tuple[float, ...]


#: Measures as SQL over COUNTS; all are between 0 and 1; ``{q}`` is where they are.
RULES = (
    Rule("symbols", "{q}n_symbols / greatest({q}word_chars, 1)", tuple(x / 100 for x in range(60, 1, -1))),
    Rule("upper", "{q}n_upper / greatest({q}word_chars, 1)", tuple(x / 100 for x in range(98, 9, -2))),
    Rule("marks", "{q}n_marks / greatest({q}n_words, 1)", tuple(x / 100 for x in range(98, 9, -2))),
    Rule("dup_lines", "{q}n_dup_lines / greatest({q}n_lines, 1)", tuple(x / 100 for x in range(98, 9, -2))),
    Rule("repeats", "{q}n_repeat_words / greatest({q}n_words, 1)", tuple(x / 100 for x in range(98, 4, -2))),
    Rule("same_words", "{q}n_same_words / greatest({q}n_words, 1)", tuple(x / 100 for x in range(98, 4, -2))),
)


def _distinct_repeats(owner: np.ndarray, hashes: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """For entries with a text and a hash: whether the same pair occurs elsewhere, and whether it occurred before."""
    n = len(hashes)
    twice, again = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if n:
        keys = hashes ^ _text.mix(owner.astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        again[order[1:]] = same
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
    return twice, again


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS for each text of a window."""
    n = len(offsets) - 1
    word_byte = _text.NOT_SPACE[data]
    starts, ends, first = _text.spans(word_byte, offsets)
    spans = _text.SpanHash(data)
    words = spans(starts, ends)
    owner = np.repeat(np.arange(n), np.diff(first))

    def bytes_of(flags: np.ndarray) -> np.ndarray:
        return _text.per_text(flags, offsets)

    w = REPEAT_WORDS
    repeated = np.zeros(len(words) + 1, dtype=np.int64)
    if len(words) >= w:
        at = np.flatnonzero(owner[: len(words) - w + 1] == owner[w - 1 :])
        window = np.zeros(len(at), dtype=np.uint64)
        for k in range(w):
            window = _text.mix(window * np.uint64(0x9E3779B97F4A7C15) + words[at + k])
        twice, _ = _distinct_repeats(owner[at], window, n)
        np.add.at(repeated, at[twice], 1)
        np.add.at(repeated, at[twice] + w, -1)
    covered = np.cumsum(repeated[:-1]) > 0

    line_starts, line_ends, line_first = _text.spans(data != 10, offsets)
    line_owner = np.repeat(np.arange(n), np.diff(line_first))
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_owner = line_starts[has_word], line_ends[has_word], line_owner[has_word]
    _, again = _distinct_repeats(line_owner, spans(line_starts, line_ends), n)
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])

    leads = _LEADS[data]
    return {
        "n_words": np.diff(first),
        "word_chars": bytes_of(leads & word_byte),
        "n_symbols": bytes_of(_CLASS_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_owner, weights=again, minlength=n).astype(np.int64),
        "n_repeat_words": _text.per_text(covered, first),
        "n_upper": bytes_of(_UPPER[data]),
        "n_chars": bytes_of(leads),
        "n_lines": np.bincount(line_owner, minlength=n),
        "n_same_words": _text.per_text(same, first),
        "n_marks": bytes_of(_MARKS[data]),
    }


def counts(text: Column | str) -> Column:
    """COUNTS of a text as a struct of longs."""

    @F.arrow_udf("struct<" + ", ".join(f"{c}: long" for c in COUNTS) + ">")
    def of(column: pa.Array) -> pa.Array:
        parts = [measure(w.data, w.offsets) for w in _text.windows(column)]
        joined = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for c in COUNTS]
        return pa.StructArray.from_arrays([pa.array(a.astype(np.int64)) for a in joined], names=list(COUNTS))

    return of(text)


def base_failed(where: str = "") -> Column:
    """Over COUNTS, in columns or in the struct named by ``where`` (with its dot)."""
    return F.expr(f"{where}n_words < 20 or 100 * {where}n_repeat_words > 30 * {where}n_words")


def binomial_tail(k: int, n: int, p: float) -> float:
    """The chance of at most ``k`` successes in ``n`` trials of chance ``p``, summed exactly in logarithms."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    i = np.arange(1, k + 1)
    steps = np.log((n - i + 1) / i) + math.log(p) - math.log1p(-p)
    logs = n * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(steps)])
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


@dataclass(frozen=True)
class Tally:
    """Labelled documents of a stratum: how many are good and bad, and how many of them each cutoff of a rule rejects."""

    n_good: int
    n_bad: int
    good: list[int]
    bad: list[int]


def choose(table: dict[tuple[object, str], Tally], rules: tuple[Rule, ...] = RULES, risk: float = RISK, delta: float = DELTA) -> dict[object, dict[str, float]]:
    """Cutoffs by stratum and rule.

    Each rule may use ``risk`` / rules, so that all rules of a stratum together
    stay within ``risk``.  Of the cutoffs that pass, the one is taken that rejects
    the largest share of bad documents less ``GOOD_COSTS`` times that of good ones;
    of equals the mildest; none if that isn't above zero.
    """
    by_name = {r.name: r for r in rules}
    chosen: dict[object, dict[str, float]] = {}
    for (stratum, name), t in table.items():
        most, limit = 0.0, risk / len(rules)
        for cutoff, good, bad in zip(by_name[name].grid, t.good, t.bad, strict=True):
            if good > t.n_good * limit or binomial_tail(good, t.n_good, limit) > delta / max(1, len(table)):
                break
            gain = bad / max(1, t.n_bad) - GOOD_COSTS * good / max(1, t.n_good)
            if gain > most:
                most = gain
                chosen.setdefault(stratum, {})[name] = cutoff
    return chosen


def least_good(strata: int, rules: tuple[Rule, ...] = RULES, risk: float = RISK, delta: float = DELTA) -> int:
    """How many labelled good documents a stratum needs for any cutoff."""
    return math.ceil(math.log(delta / (strata * len(rules))) / math.log1p(-risk / len(rules)))


def learn(measured: DataFrame, *, stratum: str = STRATUM, good: str = "good", rules: tuple[Rule, ...] = RULES, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Cutoffs from labelled rows with COUNTS, a stratum and whether the document is good: stratum and a column a rule (null: none).

    Each row is put at the number of cutoffs it reaches, for each rule, and these are
    counted by stratum.  A stratum's choice is then a group of at most as many rows as
    the rules have cutoffs.  Strata without any cutoff have no row.
    """
    known = measured.where(F.col(good).isNotNull()).select(F.col(stratum).alias("stratum"), F.col(good).alias("good"), *COUNTS)
    n_strata = known.agg(F.count_distinct("stratum") + F.max(F.when(F.col("stratum").isNull(), 1).otherwise(0))).first()[0] or 0
    places = []
    for r in rules:
        grid = ", ".join(f"{c}D" for c in r.grid)
        places.append(F.struct(F.lit(r.name).alias("rule"), F.expr(f"size(filter(array({grid}), c -> {r.measure.format(q='')} >= c))").alias("reached")))
    placed = known.select("stratum", "good", F.inline(F.array(*places))).groupBy("stratum", "rule", "reached").agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))
    kind = measured.schema[stratum].dataType.simpleString()
    schema = ", ".join([f"stratum {kind}", *(f"`{r.name}` double" for r in rules)])

    def one(table: pa.Table) -> pa.Table:
        found = {(r["rule"], r["reached"]): (r["n_good"], r["n_bad"]) for r in table.to_pylist()}
        tallies = {}
        for r in rules:
            n = len(r.grid)
            at = [found.get((r.name, k), (0, 0)) for k in range(n + 1)]
            # The i-th cutoff rejects what reaches at least n - i of them.
            sums = [tuple(map(sum, zip(*at[n - i :], strict=True))) for i in range(n)]
            n_good, n_bad = map(sum, zip(*at, strict=True))
            tallies[0, r.name] = Tally(n_good, n_bad, [g for g, _ in sums], [b for _, b in sums])
        chosen = choose(tallies, rules, risk, delta / max(1, n_strata)).get(0, {})
        columns = [table["stratum"].slice(0, 1 if chosen else 0)]
        columns += [pa.array([chosen.get(r.name)] if chosen else [], type=pa.float64()) for r in rules]
        return pa.Table.from_arrays(columns, names=["stratum", *(r.name for r in rules)])

    return _store.materialize(placed.groupBy("stratum").applyInArrow(one, schema), "cutoffs")


def judged(rows: DataFrame, cutoffs: DataFrame, *, stratum: str = STRATUM, rules: tuple[Rule, ...] = RULES, where: str = "", name: str = "rejected") -> DataFrame:
    """``rows`` with whether any rule of their stratum rejects them; over COUNTS, in columns or in the struct named by ``where`` (with its dot)."""
    own, cut, salt = (_store.free_name(rows, x) for x in ("__stratum", "__cutoffs", "__salt"))
    table = cutoffs.select(F.col("stratum").alias(own), F.struct(*(F.col(f"`{r.name}`") for r in rules)).alias(cut))
    same = F.col(f"`{stratum}`").eqNullSafe(F.col(own))
    if cutoffs.count() <= BROADCAST_STRATA:
        joined = rows.join(F.broadcast(table), same, "left")
    else:
        parts = table.withColumn(f"{salt}_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*(F.col(f"{where}{c}") for c in COUNTS)), F.lit(SALTS)).cast("int"))
        joined = dealt.join(parts, same & (F.col(salt) == F.col(f"{salt}_")), "left")
    hit = F.lit(False)
    for r in rules:
        hit = hit | F.coalesce(F.expr(r.measure.format(q=where)) >= F.col(cut).getField(r.name), F.lit(False))
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns), hit.alias(name))


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``rows`` (with doc_id) and whether the document is good (null: not labelled); labels that contradict each other for one id make it good."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__key")).agg((F.max(label_col) == 1).alias("good"))
    return rows.join(known, rows["doc_id"] == known["__key"], "left").drop("__key")


def measured(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum: str = STRATUM, label_col: str = "quality") -> DataFrame:
    """doc_id, the stratum, COUNTS and whether the document is good; written once, so texts are measured once."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum).alias(stratum), counts(text_col).alias("__counts")).select("doc_id", stratum, "__counts.*")
    return _store.materialize(_labelled(rows, labels, id_col, label_col), "measured")


def keep(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum: str = STRATUM, label_col: str = "quality", **options) -> DataFrame:
    """``docs`` without those that the base rule, or a rule of their stratum learnt from ``labels``, rejects.

    Rows are written once with their counts, so texts are measured once, and joined by nothing but the cutoffs.
    """
    name, verdict = _store.free_name(docs, "__counts"), _store.free_name(docs, "__rejected")
    staged = _store.materialize(docs.withColumn(name, counts(F.col(f"`{text_col}`"))), "counted")
    rows = staged.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{stratum}`").alias("stratum"), f"{name}.*")
    cutoffs = learn(_labelled(rows, labels, id_col, label_col), stratum="stratum", **options)
    ruled = judged(staged, cutoffs, stratum=stratum, where=f"{name}.", name=verdict)
    return ruled.where(~(base_failed(f"{name}.") | F.col(verdict))).select(*(F.col(f"`{c}`") for c in docs.columns))
