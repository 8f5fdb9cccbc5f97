"""Preference formatting: the turns that a chosen and a rejected conversation begin with alike are the prompt, rendered
once; what follows becomes two completions with masks of what is to be learnt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padlake.llm import bpe
from padlake.llm.memory import trim

#: Fixed values of the rendering: before and after the role, after the text. Texts have their own ``<|`` written ``< |``.
BEFORE, AFTER, END = "<|", "|>\n", "<|end|>\n"
LEARNT = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(BEFORE), turn["role"], F.lit(AFTER))


def _tail(turn: Column) -> Column:
    return F.concat(F.replace(turn["text"], F.lit(BEFORE), F.lit("< |")), F.lit(END))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _tail(t))), "")


def _mask(turns: Column) -> Column:
    """Runs of characters of a completion: how many, and whether they are learnt."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(F.length(_head(t)).alias("n_chars"), F.lit(False).alias("learn")),
        F.struct(F.length(_tail(t)).alias("n_chars"), (t["role"] == LEARNT).alias("learn")),
    )))


def pairs(turns: DataFrame, pair: Column, rejected: Column, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(pair_id, chosen, rejected): the turns of both sides, arrays of struct(turn, role, text) by turn.

    ``pair`` numbers the pair of a row, ``rejected`` tells its side; rows for which either is null belong to none.
    Rows of a side that agree in turn, role and text count once; of equal turns the smaller role, then text, comes
    first. Null roles are "unknown", null texts empty. A pair's side without rows is an empty array. A side's distinct
    turns are in one row, as their rendering has to be; rows that repeat are merged before they are dealt.
    """
    one = F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("unknown")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = turns.select(pair.alias("pair_id"), rejected.alias("rejected"), one.alias("t")).where("pair_id IS NOT NULL AND rejected IS NOT NULL")
    side = lambda which: F.array_sort(F.collect_set(F.when(which, F.col("t"))))
    return rows.groupBy("pair_id").agg(side(~F.col("rejected")).alias("chosen"), side(F.col("rejected")).alias("rejected"))


def other_answer(own: Column, other: Column) -> Column:
    """The turns ``own`` with the text of the last answer in ``other``, or an empty one, as that of their own last answer; without an answer they stay."""
    answers = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda k: F.get(own, k)["role"] == LEARNT)
    last = F.when(F.size(own) > 0, F.try_element_at(answers, F.lit(-1)))
    text = F.coalesce(F.try_element_at(F.filter(other, lambda t: t["role"] == LEARNT), F.lit(-1))["text"], F.lit(""))
    return F.transform(own, lambda t, k: F.when(k == last, F.struct(t["turn"].alias("turn"), t["role"].alias("role"), text.alias("text"))).otherwise(t))


def answer_pairs(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(pair_id, chosen, rejected) for each conversation: as it is, and with the last answer of its neighbour, the id that differs in the last bit.

    One shuffle deals both neighbours to one row. Null conversation ids belong to none.
    """
    one = F.col(f"`{conversation}`").cast("long")
    both = pairs(turns, F.shiftright(one, 1), one.bitwiseAND(F.lit(1)) != 0, turn, role, text)
    sides = [F.struct((F.col("pair_id") * 2 + k).alias("pair_id"), F.col(a).alias("own"), F.col(b).alias("other")) for k, a, b in ((0, "chosen", "rejected"), (1, "rejected", "chosen"))]
    each = both.select(F.explode(F.array(*sides)).alias("s")).select("s.*").where(F.size("own") > 0)
    return each.select("pair_id", F.col("own").alias("chosen"), other_answer(F.col("own"), F.col("other")).alias("rejected"))


def format_pairs(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``df`` with n_common, prompt, chosen_text, rejected_text, chosen_mask, rejected_mask in place of the two arrays.

    The prompt is the longest prefix of turns equal in role and text on both sides; the same conversations twice leave
    two empty completions. Null arrays count as empty. In a mask the text of assistant turns, with its end mark, is
    learnt; headers and other roles aren't. Columns of those names are replaced, others pass; every row stays.
    """
    a, b = F.coalesce(F.col(f"`{chosen}`"), F.array().cast(df.schema[chosen].dataType)), F.coalesce(F.col(f"`{rejected}`"), F.array().cast(df.schema[rejected].dataType))
    most = F.least(F.size(a), F.size(b))
    at = F.sequence(F.lit(0), most - 1)
    differ = F.filter(at, lambda k: ~(F.get(a, k)["role"].eqNullSafe(F.get(b, k)["role"]) & F.get(a, k)["text"].eqNullSafe(F.get(b, k)["text"])))
    n = F.when(most == 0, 0).otherwise(F.coalesce(F.get(differ, 0), most))
    rest = lambda x: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))
    new = {
        "n_common": n.cast("long"),
        "prompt": _rendered(F.slice(a, 1, n)),
        "chosen_text": _rendered(rest(a)),
        "rejected_text": _rendered(rest(b)),
        "chosen_mask": _mask(rest(a)),
        "rejected_mask": _mask(rest(b)),
    }
    return df.withColumns(new).drop(*({chosen, rejected} - set(new)))


def mask_text(mask: str) -> Column:
    """A mask as text: ``n+`` for learnt runs and ``n-`` for others, joined by commas."""
    return F.array_join(F.transform(F.col(mask), lambda r: F.concat(r["n_chars"].cast("string"), F.when(r["learn"], "+").otherwise("-"))), ",")


def token_masks(df: DataFrame, path: str, sides: tuple[str, ...] = ("chosen", "rejected"), prompt: str = "prompt") -> DataFrame:
    """``df``, as ``format_pairs`` has made it, with prompt_ids and, for each side, <side>_ids and <side>_learn.

    Ids are those of the tokenizer at ``path``; each run of a mask is encoded by itself, so that no token is in two
    runs. <side>_learn has one flag for each id of the completion. Null or empty texts and masks have no ids.
    """
    df = bpe.encode(df, path, prompt, "prompt_ids")
    for side in sides:
        mask, text = f"{side}_mask", F.col(f"`{side}_text`")
        begin = lambda k: F.aggregate(F.slice(mask, 1, k), F.lit(0), lambda n, r: n + r["n_chars"])
        parts = F.transform(F.col(mask), lambda r, k: F.struct(F.substring(text, begin(k) + 1, r["n_chars"]).alias("part"), r["learn"].alias("learn")))
        df = df.withColumn(f"{side}_ids", _run_ids(path)(F.coalesce(F.transform(parts, lambda p: p["part"]), F.array().cast("array<string>"))))
        flags = F.flatten(F.transform(F.arrays_zip(F.col(f"{side}_ids").alias("ids"), F.transform(F.col(mask), lambda r: r["learn"]).alias("learn")), lambda z: F.transform(z["ids"], lambda _: z["learn"])))
        df = df.withColumn(f"{side}_learn", F.coalesce(flags, F.array().cast("array<boolean>"))).withColumn(f"{side}_ids", F.flatten(f"{side}_ids"))
    return df


def _run_ids(path: str):
    @F.arrow_udf("array<array<int>>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = bpe.transducer(path)
        kind = pa.list_(pa.list_(pa.int32()))
        for runs in batches:
            yield pa.array([[np.frombuffer(t.encode(x or ""), np.int32) for x in parts] for parts in runs.to_pylist()], kind)
            trim()

    return ids


def oracle() -> str:
    """DuckDB SQL for the query over conversations: each as it is against itself with its neighbour's last answer."""
    return f"""
    WITH turns AS (
        SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM turns),
    answers AS (SELECT conv_id, max(pos) AS last, arg_max(text, pos) AS text FROM placed WHERE role = '{LEARNT}' GROUP BY conv_id),
    sides AS (
        SELECT conv_id AS pair_id, 0 AS side, pos, role, text FROM placed UNION ALL
        SELECT p.conv_id, 1, p.pos, p.role, CASE WHEN p.pos = own.last THEN coalesce(other.text, '') ELSE p.text END
        FROM placed p LEFT JOIN answers own ON own.conv_id = p.conv_id LEFT JOIN answers other ON other.conv_id = xor(p.conv_id, 1)),
    numbered AS (
        SELECT *, '{BEFORE}' || role || '{AFTER[:-1]}' || chr(10) AS head, replace(text, '{BEFORE}', '< |') || '{END[:-1]}' || chr(10) AS tail FROM sides),
    first_other AS (
        SELECT a.pair_id, min(a.pos) AS pos FROM numbered a JOIN numbered b ON a.pair_id = b.pair_id AND a.pos = b.pos AND a.side = 0 AND b.side = 1
        WHERE a.role != b.role OR a.text != b.text GROUP BY a.pair_id),
    common AS (SELECT pair_id, coalesce(any_value(f.pos) - 1, max(n.pos)) AS n FROM numbered n LEFT JOIN first_other f USING (pair_id) GROUP BY pair_id)
    SELECT pair_id, any_value(n)::BIGINT AS n_common,
        coalesce(string_agg(head || tail, '' ORDER BY pos) FILTER (WHERE side = 0 AND pos <= n), '') AS prompt,
        coalesce(string_agg(head || tail, '' ORDER BY pos) FILTER (WHERE side = 0 AND pos > n), '') AS chosen_text,
        coalesce(string_agg(head || tail, '' ORDER BY pos) FILTER (WHERE side = 1 AND pos > n), '') AS rejected_text,
        coalesce(string_agg(length(head) || '-,' || length(tail) || CASE WHEN role = '{LEARNT}' THEN '+' ELSE '-' END, ',' ORDER BY pos) FILTER (WHERE side = 0 AND pos > n), '') AS chosen_mask,
        coalesce(string_agg(length(head) || '-,' || length(tail) || CASE WHEN role = '{LEARNT}' THEN '+' ELSE '-' END, ',' ORDER BY pos) FILTER (WHERE side = 1 AND pos > n), '') AS rejected_mask
    FROM numbered JOIN common USING (pair_id) GROUP BY pair_id"""
