"""Quality rules with adaptive thresholds (operator 1); DataFrame functions only.

Every text is measured in one pass of built-in functions. The rates (in
thousandths, or tenths of a character) are counted into quantile sketches, one
per language, source and rate: counts of bins that are exact below 128 and a 64th
of their value wide at most above, so that two sketches merge by adding counts,
in any order and to the same result, and a quantile is off by a 64th at most.
The rows of a hot source collapse to its bins, at most 3,776 for any 64-bit
value, before they are shuffled. Thresholds
follow from the quartiles: a text is rejected where a rate is beyond its median
by more than `spread` times the distance from the median to its nearer quartile,
and by more than that rate's own slack. Junk on less than half of a group leaves
one quartile clean, so it cannot widen the limits past a clean quartile's; junk on
more than half is the group's norm.
Groups of fewer than `least_rows` texts take the merged sketch of their language,
and languages as small the sketch of all.

The thresholds are joined to the texts on language and source, null being one
value of either. They are broadcast when counting them shows at most
`most_broadcast` rows, and otherwise joined by a shuffle whose hot partitions
adaptive execution can split.

Defined results: null, empty and blank texts have no words and fail the base
rules; a very long text is measured whole, as one row; a null language or source
is a group like any other; a rate that ties with its limit passes; equal rows
get equal verdicts; an empty table gives no rows; extra columns are kept by
`filter_documents` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch

SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
SPREAD, LEAST_ROWS, MOST_BROADCAST = 4, 200, 20_000
#: Rate, its slack above the median and its slack below (None: no lower limit).
RATES = (("noise_rate", 60, None), ("dup_line_rate", 500, None), ("word_length", 40, 20))


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(hashes: Column) -> Column:
    """Words covered by WINDOW-word windows that occur twice or more, from an array of word hashes."""
    windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    def covered(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["total"] + p + WINDOW - F.greatest(p, a["end"])).alias("total"), (p + WINDOW).alias("end"))
        return F.aggregate(F.sort_array(found), start, step, lambda a: a["total"])

    def twins(ordered: Column) -> Column:
        def at(k):
            return F.get(ordered, k)

        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        marked = F.transform(ordered, lambda x, k: F.when(same(x, at(k - 1)) | same(x, at(k + 1)), x["i"]))
        return covered(F.filter(marked, lambda i: i.isNotNull()))

    def of(all_windows: Column) -> Column:
        ordered = F.sort_array(F.transform(all_windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(all_windows)) == F.size(all_windows), F.lit(0)).otherwise(let(ordered, twins))

    return F.when(F.size(hashes) < WINDOW, F.lit(0)).otherwise(let(windows, of))


def without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))


def measures(text: Column) -> Column:
    """A struct of counts of one text."""
    known = F.coalesce(text.cast("string"), F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
            let(F.transform(words, lambda w: F.xxhash64(w)), repeated_words).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda line: F.trim(line, F.lit(SPACES)) != "")
        marks = F.struct(without(t, "#*$%&|<>").cast("long").alias("n_symbols"), without(t, "!#*$%&|<>").cast("long").alias("n_noise"))
        return F.struct(let(words, of_words).alias("w"), let(lines, of_lines).alias("l"), marks.alias("m"))

    return let(known, of)


def measured(docs: DataFrame, *keep) -> DataFrame:
    """The columns `keep` with counts and rates of each text.

    The counts come out of a generator of one row, below which no filter on them
    can be pushed: a filter would measure the text again for each count it names.
    """
    names = docs.select(*keep).columns
    counts = docs.select(*keep, F.inline(F.array(measures(docs["text"])))).toDF(*names, "_w", "_l", "_m").select(*names, "_w.*", "_l.*", "_m.*")
    rate = lambda a, b, unit: F.floor(F.col(a) * unit / F.greatest(F.col(b), F.lit(1))).cast("long")
    return counts.withColumns(
        {
            "noise_rate": rate("n_noise", "word_chars", 1000),
            "dup_line_rate": rate("n_dup_lines", "n_lines", 1000),
            "word_length": rate("word_chars", "n_words", 10),
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        }
    )


def bin_of(v: Column) -> Column:
    """The least value of v's bin: v itself below 128, else v with all but its first seven bits cleared."""
    low = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, low), low)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, rate, bin, c) counts of the texts that pass the base rules."""
    rates = F.explode(F.array(*[F.struct(F.lit(name).alias("rate"), F.col(name).alias("v")) for name, _, _ in RATES])).alias("x")
    binned = rows.filter("NOT base_failed").select("lang", "source", rates).select("lang", "source", "x.rate", bin_of(F.col("x.v")).alias("bin"))
    return binned.groupBy("lang", "source", "rate", "bin").agg(F.count("*").alias("c"))


def _quartiles(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, rate, total, q25, q50, q75) of sketches merged by `by`."""
    merged = counts.groupBy(*by, "rate", "bin").agg(F.sum("c").alias("c"))
    lists = merged.groupBy(*by, "rate").agg(F.sum("c").alias("total"), F.sort_array(F.collect_list(F.struct("bin", "c"))).alias("bins"))  # at most 3,776 bins

    def quantile(percent: int) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin"))
        step = lambda a, x: F.struct((a["seen"] + x["c"]).alias("seen"), F.coalesce(a["bin"], F.when((a["seen"] + x["c"]) * 100 >= F.col("total") * percent, x["bin"])).alias("bin"))
        return F.aggregate("bins", start, step, lambda a: a["bin"])

    return lists.select(*by, "rate", "total", *[quantile(p).alias(f"q{p}") for p in (25, 50, 75)])


def thresholds(counts: DataFrame, spread: int = SPREAD, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(lang, source, least_<rate>, most_<rate>): one row for each language and source in `counts`."""
    own = _quartiles(counts, ["lang", "source"])
    language = _quartiles(counts, ["lang"]).select(F.col("lang").alias("l"), F.col("rate").alias("r"), F.struct("total", "q25", "q50", "q75").alias("by_language"))
    whole = _quartiles(counts, []).select(F.col("rate").alias("w"), F.struct("total", "q25", "q50", "q75").alias("of_all"))
    joined = own.join(language, F.col("lang").eqNullSafe(F.col("l")) & (F.col("rate") == F.col("r"))).join(F.broadcast(whole), F.col("rate") == F.col("w"))  # a row a rate
    chosen = F.when(F.col("total") >= least_rows, F.struct("total", "q25", "q50", "q75")).when(F.col("by_language.total") >= least_rows, F.col("by_language")).otherwise(F.col("of_all"))
    rows = joined.select("lang", "source", "rate", chosen.alias("q"))
    nearer = spread * F.least(F.col("q.q75") - F.col("q.q50"), F.col("q.q50") - F.col("q.q25"))
    limits = []
    for name, above, below in RATES:
        is_rate = F.col("rate") == name
        limits.append(F.max(F.when(is_rate, F.col("q.q50") + F.greatest(nearer, F.lit(above)))).alias(f"most_{name}"))
        if below is not None:
            limits.append(F.max(F.when(is_rate, F.col("q.q50") - F.greatest(nearer, F.lit(below)))).alias(f"least_{name}"))
    return rows.groupBy("lang", "source").agg(*limits)


def judged(rows: DataFrame, limits: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """`rows` with `kept`: not failed by the base rules, and no rate beyond the limits of its group."""
    limits = limits.withColumnsRenamed({"lang": "_skein_lang", "source": "_skein_source"})
    if limits.count() <= most_broadcast:
        limits = F.broadcast(limits)  # its size was just counted
    on = rows["lang"].eqNullSafe(F.col("_skein_lang")) & rows["source"].eqNullSafe(F.col("_skein_source"))
    inside = F.lit(True)
    for name, _, below in RATES:
        inside = inside & (F.col(name) <= F.col(f"most_{name}"))
        if below is not None:
            inside = inside & (F.col(name) >= F.col(f"least_{name}"))
    drop = ["_skein_lang", "_skein_source", *[c for c in limits.columns if c.startswith(("most_", "least_"))]]
    return rows.join(limits, on, "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop(*drop)


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, rates, base_failed, kept) of every row of `docs`."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.write(measured(docs, docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source")), "rows")
    limits = scratch.write(thresholds(scratch.write(sketches(rows), "sketches")), "limits")
    return scratch.result(judged(rows, limits).drop("lang", "source"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, all columns unchanged.

    The texts are measured once and written with their counts, of which the
    sketches read the counts alone; texts are never shuffled.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_skein_row")
    rows = scratch.write(measured(docs, whole, docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source")), "rows")
    limits = scratch.write(thresholds(scratch.write(sketches(rows.drop("_skein_row")), "sketches")), "limits")
    return judged(rows, limits).filter("kept").select("_skein_row.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """The same rows in DuckDB SQL, by counting whole windows instead of hashes."""
    rate = "CASE WHEN v < 128 THEN v ELSE (v >> (length(bin(v)) - 7)) << (length(bin(v)) - 7) END"
    unions = " UNION ALL ".join(f"SELECT lang, source, '{name}' AS rate, {name} AS v FROM m WHERE NOT base_failed" for name, _, _ in RATES)

    def quartiles(name: str, by: str) -> str:
        keys = f"{by}, " if by else ""
        cols = ", ".join(f"min(bin) FILTER (WHERE seen * 100 >= total * {p}) AS q{p}" for p in (25, 50, 75))
        return f"""{name} AS (
            SELECT {keys}rate, max(total) AS total, {cols} FROM (
                SELECT {keys}rate, bin, sum(c) OVER (PARTITION BY {keys}rate ORDER BY bin) AS seen, sum(c) OVER (PARTITION BY {keys}rate) AS total
                FROM (SELECT {keys}rate, bin, sum(c) AS c FROM sketch GROUP BY {keys}rate, bin))
            GROUP BY {keys}rate)"""

    limits, inside = [], []
    for name, above, below in RATES:
        limits.append(f"max(q50 + greatest({SPREAD} * least(q75 - q50, q50 - q25), {above})) FILTER (WHERE rate = '{name}') AS most_{name}")
        inside.append(f"{name} <= most_{name}")
        if below is not None:
            limits.append(f"max(q50 - greatest({SPREAD} * least(q75 - q50, q50 - q25), {below})) FILTER (WHERE rate = '{name}') AS least_{name}")
            inside.append(f"{name} >= least_{name}")
    chosen = ", ".join(f"CASE WHEN o.total >= {LEAST_ROWS} THEN o.q{p} WHEN l.total >= {LEAST_ROWS} THEN l.q{p} ELSE w.q{p} END AS q{p}" for p in (25, 50, 75))
    return f"""
    WITH d AS (
        SELECT doc_id, lang, source, coalesce(text, '') AS t,
               list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS lines
        FROM documents),
    win AS (SELECT doc_id, i, list_slice(words, i, i + {WINDOW - 1}) AS w FROM d, unnest(range(1, len(words) - {WINDOW - 2})) AS r(i) WHERE len(words) >= {WINDOW}),
    rep AS (
        SELECT doc_id, count(DISTINCT p) AS n FROM (
            SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1)
        GROUP BY doc_id),
    c AS (
        SELECT d.doc_id, lang, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
               (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
               (length(t) - length(regexp_replace(t, '[!#*$%&|<>]', '', 'g')))::BIGINT AS n_noise,
               len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
        FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
    m AS (
        SELECT *, n_noise * 1000 // greatest(word_chars, 1) AS noise_rate, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_line_rate,
               word_chars * 10 // greatest(n_words, 1) AS word_length,
               n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed
        FROM c),
    sketch AS (SELECT lang, source, rate, {rate} AS bin, count(*) AS c FROM ({unions}) GROUP BY ALL),
    {quartiles("o", "lang, source")}, {quartiles("l", "lang")}, {quartiles("w", "")},
    q AS (
        SELECT o.lang, o.source, o.rate, {chosen}
        FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rate = l.rate JOIN w ON o.rate = w.rate),
    lim AS (SELECT lang, source, {", ".join(limits)} FROM q GROUP BY lang, source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND coalesce({" AND ".join(inside)}, true) AS kept
    FROM m LEFT JOIN lim ON m.lang IS NOT DISTINCT FROM lim.lang AND m.source IS NOT DISTINCT FROM lim.source
    """


OP1_SQL = _sql()
