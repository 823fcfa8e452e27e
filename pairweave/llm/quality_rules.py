"""Weak supervision of quality: rules vote or abstain, EM weighs them, a posterior decides.

Native: DataFrame and SQL functions only. Each rule looks at counts of a text and votes good, bad
or nothing. A two-class model with one conditional distribution of votes per rule and class is
fitted by expectation-maximisation on the table of distinct vote patterns (at most 3 to the number
of rules rows, whatever the input's size); the posterior of each pattern is joined back.

Scale: one pass over the texts, written as a narrow table of counts; one map-side combined
aggregation to at most 6561 rows; a broadcast join with these.

Cases: null or empty text has no words and fails the base test; a text without a rule's grounds
gets its abstention; a very long text is counted whole, as one row's arrays of words and windows;
texts with equal votes tie and share one posterior, and a posterior of just the threshold keeps; an
empty table gives an empty result; repeated rows are all kept; only doc_id and text are read, so other
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairweave.llm.common import materialize, table

_SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
BAD, NONE, GOOD = 0, 1, 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that are found at least twice; windows are compared by 64-bit hash."""

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda a, x: F.struct((a.n + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last"))
        return F.aggregate(starts, first, step, lambda a: a.n)

    def repeated(grams: Column) -> Column:
        by_hash = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1).h == x.h)) | F.coalesce(F.get(s, k + 1).h == x.h, F.lit(False)))
        return covered(F.array_sort(F.transform(let(by_hash, same), lambda x: x.i)))

    grams = let(words, lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(repeated(g)))


def _left(text: Column, dropped: str) -> Column:
    return F.char_length(F.regexp_replace(text, dropped, "")).cast("long")


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text."""
    trimmed = F.btrim(F.col("t"), F.lit(_BLANKS))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    shape = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    line_shape = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    counted = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t")).select(
        "doc_id", shape.alias("w"), line_shape.alias("l"), _left(F.col("t"), r"[^#*$%&|<>]+").alias("n_symbols"), _left(F.col("t"), r"[^\p{Lu}]+").alias("n_upper")
    )
    return counted.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper")


def rules() -> dict[str, Column]:
    """Votes by rule name. Most rules can only find fault: what they pass they abstain on."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")

    def vote(bad: Column, good: Column | None = None) -> Column:
        found = F.when(n == 0, NONE).when(bad, BAD)
        return (found if good is None else found.when(good, GOOD)).otherwise(NONE)

    tidy = (50 * F.col("n_symbols") <= n) & (100 * F.col("n_repeat_words") <= 15 * n) & (100 * F.col("n_upper") <= 15 * chars) & (20 * F.col("n_dup_lines") <= lines)
    return {
        "symbols": vote(5 * F.col("n_symbols") > n),
        "symbol_share": vote(25 * F.col("n_symbols") > chars),
        "lines": vote(10 * F.col("n_dup_lines") > 3 * lines),
        "repeats": vote(100 * F.col("n_repeat_words") > 30 * n),
        "word_length": vote((chars < 3 * n) | (chars > 12 * n)),
        "capitals": vote(10 * F.col("n_upper") > 4 * chars),
        "tidy": vote(F.lit(False), tidy),
        "size": vote(n < 20, n >= 100),
    }


def em_posteriors(patterns: DataFrame, n_rules: int, rounds: int = 40, strength: float = 0.1) -> DataFrame:
    """(votes, n) rows to (votes, posterior): the probability that a text with these votes is good.

    Runs inside one aggregation over the collected patterns; their number is at most 3 ** n_rules.
    The first beliefs are that a bad vote makes a text bad. Rules that fault different texts share
    no votes from which EM could learn what a fault means, so the fit is a posterior maximum: each
    class's votes have a Dirichlet prior, worth ``strength`` times all texts, under which a good
    text draws a bad vote from one rule in a hundred cases and a bad text in thirty.
    """
    cells = F.sequence(F.lit(0), F.lit(3 * n_rules - 1))

    def beliefs(x: Column, state: Column) -> Column:
        def side(name: str, share: Column) -> Column:
            likely = F.aggregate(F.transform(x.votes, lambda v, r: state[name][r * 3 + v]), F.lit(1.0), lambda a, p: a * p)
            return share * likely

        return let(F.struct(side("good", state.prior).alias("g"), side("bad", 1 - state.prior).alias("b")), lambda s: s.g / (s.g + s.b))

    def fit(weighted: Column) -> Column:
        """weighted: votes, g and b (counts that are good and bad)."""
        total = lambda name, of=weighted: F.aggregate(of, F.lit(0.0), lambda a, x: a + x[name])
        means = {"g": (0.01, 0.49, 0.5), "b": (0.3, 0.5, 0.2)}
        pseudo = lambda name, k: F.get(F.array(*map(F.lit, means[name])), k % 3)
        cell = lambda name, k: total(name, F.filter(weighted, lambda x: F.get(x.votes, F.floor(k / 3).cast("int")) == k % 3))
        share = lambda name: let(F.struct(total(name).alias("t"), ((total("g") + total("b")) * strength).alias("w")), lambda x: F.transform(cells, lambda k: (cell(name, k) + x.w * pseudo(name, k)) / (x.t + x.w)))
        return let(F.struct(total("g").alias("g"), total("b").alias("b")), lambda t: F.struct(((t.g + 1) / (t.g + t.b + 2)).alias("prior"), share("g").alias("good"), share("b").alias("bad")))

    def weigh(held: Column, belief: Callable[[Column], Column]) -> Column:
        return F.transform(held, lambda x: let(belief(x), lambda q: F.struct(x.votes.alias("votes"), (x.n * q).alias("g"), (x.n * (1 - q)).alias("b"))))

    held = patterns.agg(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"))).alias("p")).filter(F.size("p") > 0)
    start = held.select("p", fit(weigh(F.array_sort("p"), lambda x: F.when(F.array_contains(x.votes, BAD), 0.05).otherwise(0.95))).alias("s"))
    rounds_done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("s"), lambda s, _: fit(weigh(F.array_sort("p"), lambda x: beliefs(x, s))))
    fitted = start.select("p", rounds_done.alias("s"))
    return fitted.select(F.explode(F.transform("p", lambda x: F.struct(x.votes.alias("votes"), beliefs(x, F.col("s")).alias("posterior")))).alias("x")).select("x.*")


def judge(counts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``counts`` (of ``text_counts``, written to a table) with posterior, base_failed and kept."""
    named = rules()
    voted = counts.withColumn("votes", F.array(*named.values()))
    posterior = em_posteriors(voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), len(named))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    joined = voted.join(F.broadcast(posterior), "votes", "left")  # at most 3 ** 8 rows
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= threshold)).drop("votes")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = judge(materialize(text_counts(table(spark, sf_dir, "documents"))))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_fit(x: str) -> str:
    """SQL columns prior, good, bad from a list of structs (votes, g, b)."""
    total = lambda c: f"list_sum(list_transform({x}, lambda e: e.{c}))"
    both = f"({total('g')} + {total('b')})"
    means = {"g": "[0.01, 0.49, 0.5]", "b": "[0.3, 0.5, 0.2]"}
    cell = lambda c: f"coalesce(list_sum(list_transform(list_filter({x}, lambda e: e.votes[k // 3 + 1] = k % 3), lambda e: e.{c})), 0)"
    side = lambda c: f"list_transform(range(0, 24), lambda k: ({cell(c)} + 0.1 * {both} * {means[c]}[k % 3 + 1]) / ({total(c)} + 0.1 * {both}))"
    return f"({total('g')} + 1) / ({both} + 2) AS prior, {side('g')} AS good, {side('b')} AS bad"


def _sql_belief(votes: str) -> str:
    """SQL posterior of votes under the columns prior, good and bad."""
    side = lambda name, share: f"({share} * list_product(list_transform({votes}, lambda v, r: {name}[(r - 1) * 3 + v + 1])))"
    good, bad = side("good", "prior"), side("bad", "(1 - prior)")
    return f"({good} / ({good} + {bad}))"


OP1_SQL = rf"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
grams AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS k FROM t, unnest(range(1, len(w) - 1)) u(i)),
covered AS (SELECT r, count(DISTINCT j) AS n FROM grams, unnest([i, i + 1, i + 2]) u(j) WHERE k > 1 GROUP BY r),
c AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper
  FROM t LEFT JOIN covered USING (r)),
v AS (SELECT *, CASE WHEN n_words = 0 THEN [1, 1, 1, 1, 1, 1, 1, 1] ELSE [
    CASE WHEN 5 * n_symbols > n_words THEN 0 ELSE 1 END, CASE WHEN 25 * n_symbols > word_chars THEN 0 ELSE 1 END,
    CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 0 ELSE 1 END, CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 0 ELSE 1 END,
    CASE WHEN word_chars < 3 * n_words OR word_chars > 12 * n_words THEN 0 ELSE 1 END, CASE WHEN 10 * n_upper > 4 * word_chars THEN 0 ELSE 1 END,
    CASE WHEN 50 * n_symbols <= n_words AND 100 * n_repeat_words <= 15 * n_words AND 100 * n_upper <= 15 * word_chars AND 20 * n_dup_lines <= n_lines THEN 2 ELSE 1 END,
    CASE WHEN n_words < 20 THEN 0 WHEN n_words >= 100 THEN 2 ELSE 1 END] END AS votes FROM c),
p AS (SELECT list({{'votes': votes, 'n': n::DOUBLE}} ORDER BY votes) AS p FROM (SELECT votes, count(*) AS n FROM v GROUP BY votes)),
em AS (
  SELECT 0 AS i, {_sql_fit("x")} FROM (SELECT list_transform(p, lambda e: {{'votes': e.votes, 'g': e.n * CASE WHEN list_contains(e.votes, 0) THEN 0.05 ELSE 0.95 END, 'b': e.n * CASE WHEN list_contains(e.votes, 0) THEN 0.95 ELSE 0.05 END}}) AS x FROM p)
  UNION ALL
  SELECT i + 1, {_sql_fit("x")} FROM (SELECT i, list_transform(p, lambda e: {{'votes': e.votes, 'g': e.n * {_sql_belief("e.votes")}, 'b': e.n * (1 - {_sql_belief("e.votes")})}}) AS x FROM em, p WHERE i < 40)),
q AS (SELECT votes, {_sql_belief("votes")} AS posterior FROM (SELECT DISTINCT votes FROM v), (SELECT * FROM em WHERE i = 40))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND posterior >= 0.5 AS kept
FROM v JOIN q USING (votes)
"""
