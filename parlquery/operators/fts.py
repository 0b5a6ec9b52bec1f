"""Keyword search: phrases, BM25 over trigrams, best sessions, and postings.

A query is a list of groups; a message matches if it holds one alternative of
every group. A phrase of three or more characters is a group of its own; a
shorter term stands for the vocabulary's trigrams that start with it. Each
alternative is scored once.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import text as tx
from ..functions.script import anchored, phrases

Groups = list[list[str]]


def holds(phrase: str) -> Column:
    """Whether role or text hold a phrase, in any case."""
    p = phrase.lower()
    return F.lower("text").contains(p) | F.lower("role").contains(p)


def frequency(phrase: str) -> Column:
    return tx.occurrences(F.col("role"), phrase) + tx.occurrences(F.col("text"), phrase)


def length() -> Column:
    """Trigrams of a message."""
    return tx.trigrams(F.col("role")) + tx.trigrams(F.col("text"))


def grams() -> Column:
    """The trigrams of role and text, repeats included. Each match takes one
    character and looks ahead, so the time is linear in the text."""
    of = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("(?s)(?=(...))."), 1)
    return F.concat(of(F.col("role")), of(F.col("text")))


def vocabulary(messages: DataFrame) -> DataFrame:
    """``(trigram, doc, cnt)``: messages with a trigram and its occurrences. A
    message tells each trigram once for ``doc`` and each time for ``cnt``, so
    one exchange of sums is enough."""
    each = messages.select(grams().alias("g"))
    tag = lambda column, value: F.transform(column, lambda t: F.struct(t.alias("trigram"), F.lit(value).alias("first")))
    told = each.select(F.explode(F.concat(tag(F.col("g"), 0), tag(F.array_distinct("g"), 1))).alias("e")).select("e.*")
    return told.groupBy("trigram").agg(F.sum("first").alias("doc"), F.sum(1 - F.col("first")).alias("cnt"))


def expand(messages: DataFrame, term: str, most: int = model.SHORT_COMBINATIONS, index: DataFrame | None = None) -> list[str] | None:
    """Trigrams of the vocabulary that start with a short term; None if there
    are more than ``most``. They are read off the index or, without one, off the
    matches of one expression."""
    if index is not None:
        hits = index.filter(F.col("trigram").startswith(term.lower())).select(F.col("trigram").alias("t")).distinct()
    else:
        pattern = "(?s)(?=(" + tx.quote(term.lower()) + ".{" + str(3 - len(term)) + "}))."
        found = F.flatten(F.array(*[F.regexp_extract_all(F.lower(c), F.lit(pattern), 1) for c in ("role", "text")]))
        hits = messages.filter(holds(term)).select(F.explode(F.array_distinct(found)).alias("t")).distinct()
    rows = hits.orderBy("t").limit(most + 1).collect()  # at most so many trigrams matter
    return [r[0] for r in rows] if len(rows) <= most else None


def prepare(messages: DataFrame, query: str, index: DataFrame | None = None) -> Groups | None:
    """The groups of a query; None where nothing can be searched for. Too many
    combinations of short terms leave the longer phrases alone."""
    terms = phrases(anchored(query))
    fixed: Groups = [[t] for t in terms if len(t) >= 3]
    short: Groups = []
    combinations = 1
    for t in (t for t in terms if len(t) < 3):
        found = expand(messages, t, index=index)
        combinations *= len(found) if found is not None else model.SHORT_COMBINATIONS + 1
        if combinations > model.SHORT_COMBINATIONS:
            return fixed or None
        short.append(found or [])
    return fixed + short or None


def matches(messages: DataFrame, groups: Groups) -> DataFrame:
    """Messages that hold an alternative of every group."""
    if any(not g for g in groups):
        return messages.limit(0)
    return messages.filter(reduce(and_, [reduce(or_, [holds(p) for p in g]) for g in groups]))


def statistics(messages: DataFrame, flat: list[str], facts: DataFrame | None = None) -> Column:
    """Number of messages, their mean length, and messages per phrase, over all
    messages whatever is filtered; a scalar, computed by one scan. Where ``facts``
    has the first two, the messages may be those alone that can hold a phrase."""
    n, mean = F.count("*"), F.avg(length())
    if facts is not None:
        known = facts.first()
        n, mean = F.lit(known["messages"]), F.lit(known["trigrams"] / max(1, known["messages"]))
    return messages.agg(n.alias("n"), mean.alias("avgdl"), *[F.count_if(holds(p)).alias(f"df{k}") for k, p in enumerate(flat)]).select(F.struct("*")).scalar()


def bm25(messages: DataFrame, groups: Groups, index: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """``(msg_id, session_id, rank)`` of the matches; lower is better. With an
    index of trigrams, and what is known of all messages, those alone are read
    that hold all trigrams of some phrase."""
    flat = list(dict.fromkeys(p for g in groups for p in g))
    if index is not None and facts is not None and flat:
        messages = holders(index, messages, flat)
    else:
        facts = None
    found = matches(messages, groups)
    if not flat:
        return found.select("msg_id", "session_id", F.lit(0.0).alias("rank"))
    rows = found.select("msg_id", "session_id", length().cast("double").alias("dl"), *[frequency(p).cast("double").alias(f"tf{k}") for k, p in enumerate(flat)])
    rows = rows.withColumn("s", statistics(messages, flat, facts))

    def part(k: int) -> Column:
        n, df, tf = F.col("s.n"), F.col(f"s.df{k}"), F.col(f"tf{k}")
        idf = F.ln((n - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        return idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("s.avgdl"))))

    return rows.select("msg_id", "session_id", (-reduce(add, [part(k) for k in range(len(flat))])).alias("rank"))


def candidates(ranked: DataFrame, limit: int) -> DataFrame:
    """``(session_id, rank, msg_id)``: the best message of each session, the best
    sessions by rank before any boost."""
    best = ranked.filter("session_id is not null").groupBy("session_id").agg(F.min(F.struct("rank", "msg_id")).alias("b"))
    best = best.select("session_id", "b.rank", "b.msg_id")
    return best.orderBy(F.round("rank", 9), "session_id").limit(model.OVERSAMPLE * limit)


# An index for large tables: which messages hold which trigrams.


def postings(messages: DataFrame) -> DataFrame:
    """``(trigram, msg_id)``, one row a message and trigram."""
    return messages.select(F.explode(F.array_distinct(grams())).alias("trigram"), "msg_id")


def in_order(index: DataFrame) -> DataFrame:
    """Postings in ranges of trigrams and messages, so that a lookup opens the few
    files that have its trigrams, and a frequent one has many files."""
    return index.repartitionByRange("trigram", "msg_id").sortWithinPartitions("trigram", "msg_id")


#: Messages of a stretch of ids, and stretches that a read is narrowed to at most.
STRETCH, STRETCHES = 1 << 14, 512


def holders(index: DataFrame, messages: DataFrame, flat: list[str]) -> DataFrame:
    """Messages that hold all trigrams of one of the phrases, which those have that
    hold the phrase. Where they lie in few stretches of ids, only those are read."""
    own = {p: sorted({p.lower()[k : k + 3] for k in range(len(p) - 2)}) for p in flat}
    if not all(own.values()):
        return messages
    hit = index.filter(F.col("trigram").isin(sorted({g for x in own.values() for g in x})))
    whole = reduce(or_, [F.count_if(F.col("trigram").isin(x)) == len(x) for x in own.values()])
    ids = hit.groupBy("msg_id").agg(whole.alias("whole")).filter("whole").select("msg_id")
    parts = ids.select(F.floor(F.col("msg_id") / STRETCH).alias("k")).distinct().limit(STRETCHES + 1).collect()
    if len(parts) <= STRETCHES:
        near: list[list[int]] = []
        for k in sorted(r[0] for r in parts):
            if near and k == near[-1][1]:
                near[-1][1] = k + 1
            else:
                near.append([k, k + 1])
        within = [(F.col("msg_id") >= a * STRETCH) & (F.col("msg_id") < b * STRETCH) for a, b in near]
        messages = messages.filter(reduce(or_, within, F.lit(False)))
    return messages.join(ids, "msg_id", "left_semi")


def lookup(index: DataFrame, messages: DataFrame, phrase: str) -> DataFrame:
    """Messages with a phrase: those that hold all its trigrams, then verified."""
    return holders(index, messages, [phrase]).filter(holds(phrase))
