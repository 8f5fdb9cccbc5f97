"""Line dedup by content-defined chunks, in DataFrame functions only.

A polynomial hash rolls over the hashes of a document's lines; a line at which it is 0 modulo ``divisor`` ends a chunk.
As that depends on a few lines alone, a passage has the same chunks wherever it stands, but for its ends. A chunk of
two lines or more that occurs again anywhere, byte for byte, stays where it is first met, by document id and line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that the rolling hash looks at; one line in DIVISOR ends a chunk.
WINDOW, DIVISOR = 2, 4
#: Of the rolling hash: products stay below 2**60.
BASE, MODULUS = 8191, 2147483647


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def _ends(hashes: Column, window: int, divisor: int) -> Column:
    """Indexes of the lines that end a chunk; the last line always does."""

    def ends(i: Column) -> Column:
        terms = [F.coalesce(F.get(hashes, i - j), F.lit(0)) * F.lit(pow(BASE, j, MODULUS)) % MODULUS for j in range(window)]
        return (reduce(Column.__add__, terms) % MODULUS % divisor == 0) | (i == F.size(hashes) - 1)

    return F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), ends)


def chunked(df: DataFrame, text: str, key: Column, window: int, divisor: int) -> DataFrame:
    """doc, row, lines, ends: a document's key, the hash that tells rows of one key apart, its lines and its chunks' ends."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(key.alias("doc"), F.xxhash64(key, whole).alias("row"), F.split(whole, "\n", -1).alias("lines"))
    rows = rows.withColumn("hashes", F.transform("lines", _line_hash))
    return rows.select("doc", "row", "lines", _ends(F.col("hashes"), window, divisor).alias("ends"))


def _span(k: Column) -> tuple[Column, Column]:
    """First line and number of lines of chunk k."""
    start = F.coalesce(F.get(F.col("ends"), k - 1) + 1, F.lit(0))
    return start, F.get(F.col("ends"), k) - start + 1


def _chunk(k: Column) -> Column:
    """The lines of chunk k, one by one: a slice within a lambda would go through the whole array for each chunk."""
    start, n = _span(k)
    return F.transform(F.sequence(start, start + n - 1), lambda i: F.get(F.col("lines"), i))


def _chunk_text(k: Column) -> Column:
    return F.array_join(_chunk(k), "\n")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """``df`` with ``text`` without its repeated chunks, and n_lines, n_removed_lines (long).

    Rows that agree in key and text are one document, so that none of them loses lines to the other; rows of the same
    key with other texts are told apart. Null texts come back null with 0 lines, texts all of whose chunks go come
    back empty. A null key counts as the smallest. Chunks of empty lines alone are never removed. Columns named
    n_lines or n_removed_lines are replaced, all others pass through.
    """
    docs = chunked(df, text, F.col(f"`{key}`"), window, divisor)
    several = F.filter(F.sequence(F.lit(0), F.size("ends") - 1), lambda k: _span(k)[1] > 1)
    seen = docs.select("doc", "row", F.explode(F.transform(several, lambda k: F.struct(k.alias("chunk"), F.md5(_chunk_text(k).cast("binary")).alias("hash")))).alias("c"))
    often = seen.select("c.hash", "doc", "row", "c.chunk").groupBy("hash").agg(F.min(F.struct("doc", "row", "chunk")).alias("first"), F.max(F.struct("doc", "row", "chunk")).alias("last"))
    often = often.where(F.col("first") != F.col("last")).select("hash")
    # The bytes of those chunks alone are looked at.
    body = docs.select("doc", "row", F.explode(F.transform(several, lambda k: F.struct(k.alias("chunk"), _chunk_text(k).alias("body")))).alias("c")).select("doc", "row", "c.chunk", "c.body")
    body = body.where(F.length(F.replace("body", F.lit("\n"), F.lit(""))) > 0).withColumn("hash", F.md5(F.col("body").cast("binary")))
    # One key more than that of the aggregation, so that the join deals both sides itself and can split a chunk that is everywhere.
    part = F.substring("hash", 1, 4).alias("part")
    body = body.select("*", part).join(often.select("hash", part), ["hash", "part"], "left_semi").drop("part")
    first = body.groupBy("hash", "body").agg(F.min(F.struct("doc", "row", "chunk")).alias("first"))
    size = F.length("body").alias("size")
    again = body.select("*", size).join(first.select("*", size), ["hash", "body", "size"]).where(F.struct("doc", "row", "chunk") != F.col("first"))
    gone = again.groupBy("doc", "row").agg(F.collect_set("chunk").alias("gone"))

    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"), F.col(f"`{key}`").alias("doc"), F.xxhash64(F.col(f"`{key}`"), whole).alias("row"))
    rows = rows.join(gone.withColumnsRenamed({"doc": "g_doc", "row": "g_row"}), F.col("doc").eqNullSafe(F.col("g_doc")) & (F.col("row") == F.col("g_row")), "left")
    field = F.col("r").getField(text)
    rows = rows.withColumn("lines", F.split(F.coalesce(field, F.lit("")), "\n", -1))
    # A column of its own: within the lambda of the ends, all lines would be hashed again for each line.
    rows = rows.withColumn("hashes", F.when(F.col("gone").isNotNull(), F.transform("lines", _line_hash)))
    rows = rows.withColumn("ends", F.when(F.col("gone").isNotNull(), _ends(F.col("hashes"), window, divisor)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("ends") - 1), F.col("gone"))
    kept = F.flatten(F.transform(stay, _chunk))
    rows = rows.withColumn("kept", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept))
    new = {
        text: F.when(F.col("gone").isNull(), field).otherwise(F.array_join("kept", "\n")),
        "n_lines": F.when(field.isNull(), 0).otherwise(F.size("lines")).cast("long"),
        "n_removed_lines": (F.size("lines") - F.size("kept")).cast("long"),
    }
    return rows.select(*[new.get(c, F.col("r").getField(c)).alias(c) for c in df.columns], *[v.alias(c) for c, v in new.items() if c not in df.columns])


def oracle(table: str = "documents", window: int = WINDOW, divisor: int = DIVISOR) -> str:
    """DuckDB SQL for doc_id, text, n_lines, n_removed_lines of a table of unique ids and texts."""
    rolled = " + ".join(f"coalesce(lag(h, {j}) OVER w, 0) * {pow(BASE, j, MODULUS)} % {MODULUS}" for j in range(window))
    return f"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {table}),
    hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM lines),
    cut AS (SELECT *, (({rolled}) % {MODULUS} % {divisor} = 0)::INT AS ends FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    numbered AS (
        SELECT doc_id, i, line, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM cut),
    chunks AS (SELECT doc_id, chunk, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, chunk),
    ranked AS (
        SELECT *, n > 1 AND length(replace(body, chr(10), '')) > 0 AND row_number() OVER (PARTITION BY n > 1, body ORDER BY doc_id, chunk) > 1 AS gone FROM chunks)
    SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (WHERE NOT gone), '') AS text,
           sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS n_removed_lines
    FROM ranked GROUP BY doc_id"""
