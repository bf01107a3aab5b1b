"""Line dedup: overlapping three-line windows, found again anywhere, lose their later occurrences.

Lines are compared without blanks at their ends; blank lines belong to no window. A window is three consecutive lines;
a document with one or two lines is one window; a line of at least ``long_words`` words is a window by itself, so a
long passage in one line is found whatever stands around it. Windows are hashed to 128 bits. The first occurrence, by
document id and place, stays; of every later one the lines from its first to its last are covered, overlapping covers
merge, and covered lines go.

Edges: a null text stays null, an empty one empty; a document may lose all lines and is then empty (it is kept); rows
that agree in id and text are one document and get the same result; different texts under one id are ordered by a hash;
an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Lines of a window; words that make a line a window of its own; blanks that don't count at a line's ends.
LINES, LONG_WORDS, BLANKS = 3, 50, " \t\r"


def _windows(lines: int, long_words: int) -> Column:
    """Array of struct(first, last, h1, h2) over the column ``ls``: array of struct(i, t) without blank lines."""
    ls, n = F.col("ls"), F.size("ls")

    def key(*texts: Column) -> list[Column]:
        return [F.xxhash64(F.lit(seed), *texts).alias(f"h{seed}") for seed in (1, 2)]

    def window(k: Column) -> Column:
        inside = [F.get(ls, k + j) for j in range(lines)]
        return F.struct(inside[0]["i"].alias("first"), inside[-1]["i"].alias("last"), *key(*[x["t"] for x in inside]))

    short = F.array(F.struct(F.get(ls, F.lit(0))["i"].alias("first"), F.get(ls, n - 1)["i"].alias("last"),
                             *key(F.lit("short"), F.array_join(F.transform(ls, lambda x: x["t"]), "\n"))))
    none = F.slice(short, 1, 0)
    usual = F.when(n >= lines, F.transform(F.sequence(F.lit(0), n - lines), window)).when(n > 0, short).otherwise(none)
    spaces = F.filter(ls, lambda x: F.length(x["t"]) - F.length(F.replace(x["t"], F.lit(" "), F.lit(""))) >= long_words - 1)
    alone = F.transform(spaces, lambda x: F.struct(x["i"].alias("first"), x["i"].alias("last"), *key(F.lit("line"), x["t"])))
    return F.concat(usual, alone)


def occurrences(docs: DataFrame, lines: int = LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, tie, first, last, h1, h2: every window of every document (each (doc_id, text) once or more)."""
    cut = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANKS)).alias("t")))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"),
                        F.filter(cut, lambda x: x["t"] != "").alias("ls"))
            .select("doc_id", "tie", F.explode(_windows(lines, long_words)).alias("w"))
            .select("doc_id", "tie", "w.first", "w.last", "w.h1", "w.h2"))


def later_windows(docs: DataFrame, lines: int = LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, tie, first, last of every occurrence after the first."""
    occ, _ = written(occurrences(docs, lines, long_words), "line-windows")
    place = F.struct("doc_id", "tie", "first")
    twice, _ = written(occ.groupBy("h1", "h2").agg(F.min(place).alias("origin"), F.max(place).alias("final"))
                       .filter("origin < final").drop("final"), "line-repeats")
    return occ.join(twice, ["h1", "h2"]).filter(place > F.col("origin")).select("doc_id", "tie", "first", "last")


def dedup_lines(docs: DataFrame, lines: int = LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """The input with its text rewritten, and n_lines and n_removed appended (names of the input are replaced)."""
    covers = later_windows(docs, lines, long_words).groupBy("doc_id", "tie").agg(
        F.collect_set(F.struct("first", "last")).alias("_covers")).select(
        F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "_covers")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    joined = docs.select(*kept).withColumn("_hash", F.xxhash64("text")).join(
        covers, (F.col("_hash") == F.col("_tie")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left")
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields if f.name in kept}
    schema = ", ".join(f"`{k}` {v}" for k, v in fields.items()) + ", n_lines int, n_removed int"

    def rewrite(batches):
        import pyarrow as pa

        for batch in batches:
            texts, n_lines, n_removed = [], [], []
            for text, cover in zip(batch.column("text").to_pylist(), batch.column("_covers").to_pylist()):
                if text is None:
                    texts.append(None)
                    n_lines.append(0)
                    n_removed.append(0)
                    continue
                parts = text.split("\n")
                n_lines.append(len(parts))
                if cover:
                    gone, upto, rest = 0, 0, []
                    for w in sorted(cover, key=lambda w: w["first"]):
                        rest += parts[upto : max(upto, w["first"])]
                        gone += max(0, w["last"] + 1 - max(upto, w["first"]))
                        upto = max(upto, w["last"] + 1)
                    texts.append("\n".join(rest + parts[upto:]))
                    n_removed.append(gone)
                else:
                    texts.append(text)
                    n_removed.append(0)
            columns = [pa.array(texts, batch.column(c).type) if c == "text" else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int32()), pa.array(n_removed, pa.int32())],
                                             names=[*kept, "n_lines", "n_removed"])

    return joined.select(*kept, "_covers").mapInArrow(rewrite, schema)


def duckdb_sql(lines: int = LINES, long_words: int = LONG_WORDS) -> str:
    """The same result from plain string comparison, without hashes (ids are taken to be unique)."""
    tail = ", ".join(f"lead(t, {j}) OVER w AS t{j}" for j in range(1, lines))
    whole = " || chr(10) || ".join(["t", *(f"t{j}" for j in range(1, lines))])
    return f"""WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
        all_lines AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS raw FROM cut),
        solid AS (SELECT doc_id, i, trim(raw, ' ' || chr(9) || chr(13)) AS t FROM all_lines
            WHERE trim(raw, ' ' || chr(9) || chr(13)) <> ''),
        ranked AS (SELECT doc_id, i, t, count(*) OVER (PARTITION BY doc_id) AS n, lead(i, {lines - 1}) OVER w AS last, {tail}
            FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        windows AS (SELECT doc_id, i AS first, last, 'w' || {whole} AS k FROM ranked WHERE last IS NOT NULL
            UNION ALL SELECT doc_id, min(i), max(i), 's' || string_agg(t, chr(10) ORDER BY i) FROM ranked
            WHERE n < {lines} GROUP BY doc_id
            UNION ALL SELECT doc_id, i, i, 'l' || t FROM ranked WHERE length(t) - length(replace(t, ' ', '')) >= {long_words - 1}),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, first) AS rn FROM windows),
        later AS (SELECT doc_id, first, last FROM ordered WHERE rn > 1),
        covered AS (SELECT DISTINCT a.doc_id, a.i FROM all_lines a JOIN later b
            ON a.doc_id = b.doc_id AND a.i BETWEEN b.first AND b.last),
        result AS (SELECT a.doc_id, count(*) AS n_lines, count(c.i) AS n_removed,
            coalesce(string_agg(CASE WHEN c.i IS NULL THEN raw END, chr(10) ORDER BY a.i), '') AS text
            FROM all_lines a LEFT JOIN covered c ON a.doc_id = c.doc_id AND a.i = c.i GROUP BY a.doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE r.text END AS text,
            CAST(coalesce(r.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(r.n_removed, 0) AS INTEGER) AS n_removed
        FROM documents d LEFT JOIN result r ON d.doc_id = r.doc_id"""
