"""Tables of prompts and answers: sizes, malformed JSON, batched answering."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import missing
from ..session import cut_lineage
from ..sources.sinks import write_once
from .prefix import batch_labels

# Window sizing.
CHARS_PER_TOKEN, INPUT_SAFETY, HEADROOM, FLOOR = 3.0, 1.25, 2048, 1024
TIERS = [(16384, 1024), (32768, 2048), (65536, 4096), (131072, 8192), (262144, 16384)]
FAILURE_RADIUS = 400
REDUCE_CHARS, REDUCE_ROUNDS = 11000, 3


def window_sizes(hard_max: int) -> list[int]:
    """Sizes a window may take: steps that widen with size, up to the maximum."""
    sizes, low = [], 0
    for high, step in TIERS:
        sizes += range(low + step, min(high, hard_max) + 1, step)
        low = high
    return sorted({s for s in sizes if FLOOR <= s < hard_max} | {hard_max})


def token_budget(prompts: DataFrame, hard_max: int, ceiling: int | None = None) -> DataFrame:
    """Window each prompt needs: estimated input with a margin, the answer and
    headroom, rounded up to a size. The ceiling yields to real need.

    Columns: chars, output_tokens.
    """
    tokens = F.when(F.col("chars") <= 0, 0).otherwise(F.floor(F.col("chars") / CHARS_PER_TOKEN) + 1)
    needed = F.floor(F.col("input_tokens") * INPUT_SAFETY) + F.col("output_tokens") + HEADROOM
    sizes = F.array(*[F.lit(s).cast("bigint") for s in window_sizes(hard_max)])
    bucket = F.coalesce(F.array_min(F.filter(sizes, lambda s: s >= F.col("needed"))), F.lit(hard_max).cast("bigint"))
    cap = min(ceiling, hard_max) if ceiling else hard_max
    chosen = F.least(F.greatest(F.least(bucket, F.lit(cap)), F.lit(FLOOR), F.least(F.col("needed"), F.lit(hard_max))), F.lit(hard_max))
    return prompts.withColumn("input_tokens", tokens.cast("bigint")).withColumn("needed", needed.cast("bigint")).withColumn(
        "chosen", chosen.cast("bigint")).withColumn("exceeded", F.col("needed") > cap)


def _without_thoughts(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))


def _close(text: str) -> str | None:
    """Cut a truncated value behind its last complete part and close it."""
    start = min((p for p in (text.find("{"), text.find("[")) if p >= 0), default=-1)
    if start < 0:
        return None
    body, open_at, best = text[start:], [], None
    token = re.compile(r'"(?:[^"\\]|\\.)*"(\s*:)?|[{}\[\]]|(?:-?\d[\d.eE+-]*|true|false|null)(?=[\s,}\]])')
    for m in token.finditer(body):
        part = m.group(0)
        if part in "{[":
            open_at.append("}" if part == "{" else "]")
            continue
        if part in "}]" and open_at:
            open_at.pop()
        if m.group(1) is None:
            best = body[:m.end()] + "".join(reversed(open_at))
    return best


CLOSING = re.compile(r"\s*(?:[,:}\]]|$)")


def _escape_inner(text: str) -> str:
    """Escape a quotation mark inside a string: one that nothing structural follows."""
    out, inside, i = [], False, 0
    while i < len(text):
        c = text[i]
        if inside and c == "\\":
            out.append(text[i:i + 2])
            i += 2
            continue
        if c == '"':
            closing = CLOSING.match(text, i + 1) is not None
            if inside and not closing:
                c = '\\"'
            else:
                inside = not inside
        out.append(c)
        i += 1
    return "".join(out)


def _mend(text: str) -> str:
    """Comments, trailing commas, bare keys, bare words and lost closers."""
    text = re.sub(r"/\*.*?\*/|(?m:^\s*//.*$)", "", text, flags=re.S)
    text = re.sub(r",\s*([}\]])", r"\1", text)
    text = re.sub(r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", r'\1"\2"\3', text)
    text = re.sub(r"(:\s*)(?!true\b|false\b|null\b)([A-Za-z][^,}\]\"\n]*?)(\s*[,}\]\n])", r'\1"\2"\3', text)
    out, stack = [], []
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[{}\[\]]|[^"{}\[\]]+|"', text):
        part = m.group(0)
        if part in "{[":
            stack.append("}" if part == "{" else "]")
        elif part in "}]":
            if part not in stack:
                continue
            while stack[-1] != part:
                out.append(stack.pop())
            stack.pop()
        out.append(part)
    return "".join(out) + "".join(reversed(stack))


def _fields(text: str) -> str | None:
    """Named fields picked out of a text that is no JSON at all."""
    found = dict(re.findall(r'"(\w+)"\s*:\s*"([^"]*)"', text))
    found.update({k: v.lower() == "true" for k, v in re.findall(r'"(\w+)"\s*:\s*(true|false)', text, re.I)})
    return json.dumps(found) if found else None


def _sliced(text: str) -> str | None:
    a, b = text.find("{"), text.rfind("}")
    return text[a:b + 1] if 0 <= a < b else None


def _fenced(text: str) -> str | None:
    m = re.search(r"```(?:json)?\s*(.*?)\s*```", text, re.S)
    return m.group(1) if m else None


STAGES: list[tuple[str, Callable[[str], str | None]]] = [
    ("fence", _fenced), ("braces", _sliced), ("truncated", _close),
    ("inner quotes", lambda t: _escape_inner(_sliced(t) or t)),
    ("inner quotes, truncated", lambda t: _close(_escape_inner(t))),
    ("mended", lambda t: _mend(_sliced(t) or t[max(t.find("{"), 0):])), ("fields", _fields)]


def repair_json(answers: DataFrame) -> DataFrame:
    """Answers as JSON text with the stage that recovered them.

    Well-formed answers are recognised natively; only the others reach the
    repair stages. Nothing recoverable leaves a null value.
    """
    clean = answers.withColumn("_t", _without_thoughts(F.col("raw"))).withColumn("_ok", _valid(F.col("_t")))

    @F.pandas_udf("struct<stage:string,value:string>")
    def repair(texts: pd.Series) -> pd.DataFrame:
        def attempt(text):
            for stage, mend in STAGES if text else []:
                try:
                    value = mend(text)
                    if value:
                        loaded = json.loads(value)
                        if isinstance(loaded, (dict, list)):
                            return stage, json.dumps(loaded, ensure_ascii=False)
                except ValueError:
                    continue
            return None, None
        return pd.DataFrame([attempt(t) for t in texts], columns=["stage", "value"])

    done = clean.withColumn("_r", repair(F.when(~F.col("_ok"), F.col("_t"))))
    return done.withColumn("stage", F.when(F.col("_ok"), F.lit("direct")).otherwise(F.col("_r.stage"))).withColumn(
        "value", F.when(F.col("_ok"), F.col("_t")).otherwise(F.col("_r.value"))).drop("_t", "_ok", "_r")


def _valid(c: Column) -> Column:
    """Complete JSON object or array. The variant parser rejects cut-off text,
    which a schema-driven parser would fill with nulls."""
    return F.coalesce(F.try_parse_json(c).isNotNull() & c.rlike(r"^\s*[{\[]"), F.lit(False))


def dead_letter_json(answers: DataFrame) -> DataFrame:
    """Answers beyond repair with the reason and the text around the break, or the whole text if it holds no object."""
    lost = repair_json(answers).where("value is null").withColumn("_t", _without_thoughts(F.col("raw")))

    @F.pandas_udf("struct<reason:string,position:int,window:string>")
    def explain(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            part = _sliced(text or "")
            try:
                json.loads(part) if part else None
                rows.append(("no object in the answer", None, text or ""))
            except json.JSONDecodeError as e:
                rows.append((e.msg, e.pos, part[max(0, e.pos - FAILURE_RADIUS):e.pos + FAILURE_RADIUS]))
        out = pd.DataFrame(rows, columns=["reason", "position", "window"])
        return out.astype({"position": "Int32"})

    return lost.withColumn("_e", explain("_t")).select("answer_id", "raw", "_e.reason", "_e.position", "_e.window")


# Window and answer length of some kinds of work.
PROFILES = {"planning": (16384, 2048), "refine_planning": (49152, 2048), "readiness_check": (32768, 1024)}


def batch_answer(prompts: DataFrame, answer: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                 batches: int | None = None) -> DataFrame:
    """Answer prompt rows with a user function, batch by batch, on the executors.

    Prompts are spread evenly first. Every row carries the window and answer
    length of its task; tasks that are not listed get null.
    """
    sizes = F.create_map(*[x for k, v in PROFILES.items() for x in (F.lit(k), F.array(F.lit(v[0]), F.lit(v[1])))])
    p = prompts.withColumn("num_ctx", F.try_element_at(sizes, F.col("task"))[0]).withColumn(
        "max_tokens", F.try_element_at(sizes, F.col("task"))[1])
    spread = p.repartition(batches) if batches else p

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield answer(part)

    return spread.mapInPandas(run, schema)


def lookup_answers(prompts: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Answers taken from a table; prompts without one get null."""
    return prompts.join(known, keys, "left")


def map_reduce_text(rows: DataFrame, key: str, order: str, text: str, map_chars: int = 9000,
                    reduce_chars: int = REDUCE_CHARS, rounds: int = REDUCE_ROUNDS) -> DataFrame:
    """Pack texts into fragments under a budget, then merge fragments while they
    do not fit, a few rounds at most. A fragment holds what fits the budget (or
    one larger text), so no step gathers a whole group. Result: ordered
    fragments per key.

    All rounds work on lengths; texts are joined to their fragments once, at the end.
    """
    keyed = rows.select(key, F.col(order).cast("bigint").alias("_o"), F.col(text).alias("_x"))
    sizes = cut_lineage(keyed.select(key, "_o", F.length("_x").alias("_n")), "sizes")
    # The first pieces of a text's fragment are its `_piece`s; `_f` is the fragment a piece is in by now.
    packed = cut_lineage(batch_labels(sizes, key, "_o", "_n", map_chars).withColumnRenamed("batch", "_piece"), "batches")
    # Null texts leave no line end behind.
    current = cut_lineage(sizes.join(packed, [key, "_o"]).groupBy(key, "_piece").agg(
        _joined_length().alias("_n")).withColumn("_f", F.col("_piece")), "pieces")
    for _ in range(rounds):
        fragments = current.groupBy(key, F.col("_f").alias("_o")).agg(_joined_length().alias("_n"))
        # Only keys whose fragments do not fit go another round.
        big = fragments.groupBy(key).agg((F.sum("_n") + 2 * F.count(F.lit(1))).alias("_total"),
                                         F.count(F.lit(1)).alias("_parts")).where(
            (F.col("_total") > reduce_chars) & (F.col("_parts") > 1)).select(key)
        if big.isEmpty():
            break
        again = batch_labels(fragments.join(big, key, "left_semi"), key, "_o", "_n", reduce_chars)
        current = cut_lineage(current.join(again.withColumnRenamed("_o", "_f"), [key, "_f"], "left").select(
            key, "_piece", "_n", F.coalesce("batch", "_f").alias("_f")), "pieces")

    def lines(of: str, *by: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, of))), lambda p: p[of]), "\n")

    places = packed.join(current.select(key, "_piece", "_f"), [key, "_piece"])
    # One exchange serves both groupings.
    spread = keyed.join(places, [key, "_o"]).repartition(key, "_f")
    return spread.groupBy(key, "_f", "_piece").agg(lines("_x", "_o").alias("_x")).groupBy(key, "_f").agg(
        lines("_x", "_piece").alias("text")).select(key, F.col("_f").alias("fragment"), "text")


def _joined_length() -> Column:
    """Characters of texts joined by line ends, from their lengths `_n`."""
    return F.coalesce(F.sum("_n") + F.count("_n") - 1, F.lit(0).cast("bigint"))


def transcript_rows(turns: DataFrame) -> DataFrame:
    """Question and answer pairs of a conversation, ready to be appended."""
    q = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("turn"), F.col("text").alias("question"))
    a = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"]).where(~missing("question")).select(
        "conv_id", "turn", F.concat(F.lit("Q: "), "question", F.lit("\n\nA: "), "answer").alias("value"))


def append_transcript(turns: DataFrame, folder: str, batch: str | int | None = None) -> bool:
    """Append the pairs of some turns to the transcript, one folder for each bucket of conversations.

    A numbered batch is appended once; false if it was there. Without a number each call is a batch of its own.
    """
    rows = transcript_rows(turns).withColumn("bucket", F.pmod(F.xxhash64("conv_id"), F.lit(64)))
    return write_once(rows, folder, uuid.uuid4().hex if batch is None else batch, "bucket")
