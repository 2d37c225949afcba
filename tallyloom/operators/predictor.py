"""External predictors as row operators with a resumable append-only log.

A predictor is any object with ``predict(prompts) -> list of dict``. Each stage is an anti-join
against the log, a ``mapInPandas`` with one predictor per partition, and an append; the result is
read back from the log, so no later plan can repeat a call. The default is a deterministic stub,
there is no network code here.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.recode import clip
from tallyloom.functions.text import DIRECTIONS, STRENGTHS, alias, boolean, confidence, last_object_with, limited, limited_list, objects_in


class Predictor(Protocol):
    def predict(self, prompts: list[str]) -> list[dict]: ...


class Stub:
    """Answers from the prompt's own base probability; same prompt, same answer."""

    def predict(self, prompts: list[str]) -> list[dict]:
        out = []
        for p in prompts:
            found = objects_in(p)
            base = float((found[-1] if found else {}).get("base_probability") or 50.0)
            shift = (sum(p.encode()) % 21) - 10
            text = json.dumps({"probability_yes": max(0.0, min(100.0, base + shift)), "residual_adjustment": shift, "reason": "stub"})
            out.append({"text": text, "usage": {"input_tokens": len(p) // 4, "output_tokens": len(text) // 4}, "finish_reason": "stop"})
        return out


#: Category, words in the name of an error, words in its message; first match wins.
FAILURES = (
    ("api_rate_limit", ("ratelimit",), ("429", "rate limit")),
    ("api_timeout", ("timeout",), ("timed out",)),
    ("api_connection", ("connection", "connect"), ("connection",)),
    ("api_authentication", ("authentication",), ("401",)),
    ("api_permission", ("permission",), ("403",)),
)


def failure_category(message: Column, error_type: Column | None = None) -> Column:
    """The category of an error by its type and message; null without an error."""
    m = F.lower(F.coalesce(message, F.lit("")))
    t = F.lower(F.coalesce(error_type, F.lit(""))) if error_type is not None else F.lit("")
    out = F.when((m != "") | (t != ""), "api_other")
    for name, types, words in reversed(FAILURES):
        hit = F.lit(False)
        for c, parts in ((t, types), (m, words)):
            for w in parts:
                hit = hit | c.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


LOG_SCHEMA = (
    "config_hash string, key long, status string, text string, finish_reason string, attempt_count int,"
    " usage struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint>, error_type string, error_message string, seq long"
)


def _call(make: Callable[[], Predictor], run_hash: str, retries: int, pause: float, size: int, seq: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for b in batches:
            rows = []
            for s in range(0, len(b), size):
                part = b.iloc[s : s + size]
                got, err, attempts = None, None, 0
                while got is None and attempts <= retries:
                    attempts += 1
                    try:
                        got = client.predict(part["prompt"].tolist())
                    except Exception as e:  # noqa: BLE001 - every failure becomes an error row
                        err = e
                        time.sleep(pause * 2 ** (attempts - 1))
                for i, k in enumerate(part["key"].tolist()):
                    r = got[i] if got is not None else {}
                    u = r.get("usage") or {}
                    i_t, o_t = int(u.get("input_tokens", u.get("prompt_tokens", 0)) or 0), int(u.get("output_tokens", u.get("completion_tokens", 0)) or 0)
                    usage = {"input_tokens": i_t, "output_tokens": o_t, "total_tokens": i_t + o_t}
                    ok = got is not None
                    rows.append((run_hash, k, "ok" if ok else "error", r.get("text"), r.get("finish_reason"), attempts, usage, None if ok else type(err).__name__, None if ok else str(err)[:500], seq))
            yield pd.DataFrame(rows, columns=[c.strip().split()[0] for c in ("config_hash", "key", "status", "text", "finish_reason", "attempt_count", "usage", "error_type", "error_message", "seq")])

    return run


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as written; an absent folder is an empty log."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).json(path, mode="DROPMALFORMED")


def latest(log: DataFrame, key: str = "key", run_hash: str | None = None, *order: Column) -> DataFrame:
    """The last record of every key (of one run), by ``order`` or seq."""
    rows = log.filter(F.col("config_hash") == run_hash) if run_hash else log
    by = order or (F.col("seq").desc(), F.col("status").desc())
    from tallyloom.sources.tables import current_rows

    return current_rows(rows, key, *by)


def run_pending(
    spark: SparkSession, prompts: DataFrame, log_path: str, run_hash: str, make: Callable[[], Predictor] = Stub,
    workers: int = 8, retries: int = 2, pause: float = 0.0, size: int = 32, retry_errors: bool = True,
) -> DataFrame:
    """Call the predictor for keys without an ok record and return the latest records.

    ``prompts``: key, prompt. With ``retry_errors=False`` keys with a logged error are left alone.
    """
    log = read_log(spark, log_path)
    done = latest(log, "key", run_hash)
    done = done.filter("status = 'ok'") if retry_errors else done
    seq = int(log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]) + 1
    todo = prompts.select("key", "prompt").join(done.select("key"), "key", "left_anti")
    if not todo.isEmpty():
        called = todo.repartition(workers, "key").mapInPandas(_call(make, run_hash, retries, pause, size, seq), LOG_SCHEMA)
        called.write.mode("append").json(log_path)
    return latest(read_log(spark, log_path), "key", run_hash)


# Validators: pure columns over parsed answers.


def parse_answer(text: Column, fields: dict[str, str]) -> Column:
    """A struct of the answer's fields: of the last JSON object that holds the first field.

    Text around it, code fences and other objects are dropped.
    """
    schema = ", ".join(f"{k} {t}" for k, t in fields.items())
    return F.from_json(last_object_with(next(iter(fields)))(text), schema)


def probability(c: Column, rescale: bool = False) -> Column:
    """A probability in 0..100; with ``rescale`` values strictly between 0 and 1 are fractions."""
    x = F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))
    if rescale:
        x = F.when((x > 0) & (x < 1), x * 100).otherwise(x)
    return clip(x, 0, 100)


def decision(base: Column, adjustment: Column, stated: Column, direction: Column, most: float = 30.0) -> Column:
    """Validated decision: limited adjustment, probability, and what had to be corrected."""
    adj = clip(adjustment, -most, most)
    p = clip(base + adj, 0, 100)
    expected = F.when(adj > 2, "higher_than_pattern").when(adj < -2, "lower_than_pattern").otherwise("similar_to_pattern")
    return F.struct(
        adj.alias("residual_adjustment"), p.alias("probability_yes"), (F.abs(stated - p) > 1).alias("probability_consistency_corrected"),
        expected.alias("deviation_direction"), (direction != expected).alias("direction_consistency_corrected"),
    )


def reflection(direction: Column, required: Column, supports: Column, rule: Column, conf: Column) -> Column:
    """Validated reflection: ``valid`` needs the required direction, two supports and a rule."""
    d = alias(direction, {"increase": ("increase", "up", "raise"), "decrease": ("decrease", "down", "lower")})
    s, r = limited_list(supports, 8, 60), limited(rule, 600)
    return F.struct(
        d.alias("correction_direction"), s.alias("supporting_variables"), r.alias("correction_rule"), confidence(conf).alias("reflection_confidence"),
        (F.coalesce(d == required, F.lit(False)) & (F.size(s) >= 2) & r.isNotNull()).alias("valid"),
    )


def gate(ids: Column, retrieved: Column, residual_sign: Column, direction: Column, most: int = 3) -> Column:
    """Selected memories that were retrieved, at most ``most``; no correction if signs disagree."""
    kept = F.slice(F.filter(F.array_distinct(ids), lambda i: F.array_contains(retrieved, i)), 1, most)
    agree = F.when(direction == "increase", residual_sign > 0).when(direction == "decrease", residual_sign < 0).otherwise(False)
    return F.struct(kept.alias("memory_ids"), (F.coalesce(agree, F.lit(False)) & (F.size(kept) > 0)).alias("apply_correction"))


def gate_answer(
    apply: Column, direction: Column, ids: Column, retrieved: Column, strength: Column, summary: Column, evidence: Column, conf: Column, most: int = 3
) -> Column:
    """The validated answer of a gate.

    ``ids``: array of text; ``retrieved``: map of memory id to empirical residual. At most ``most``
    named memories that were retrieved count. An applied correction needs a direction and such
    memories (else ``error`` says what is missing) and keeps those whose residual has the sign of the
    direction; if none has, nothing is applied. A strength in other words is moderate.
    """
    d, on = alias(direction, DIRECTIONS, keep=True), F.coalesce(boolean(apply), F.lit(False))
    squeezed = lambda c, n: F.left(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(n))
    known = F.slice(F.filter(F.transform(ids, lambda i: F.trim(i)), lambda i: F.map_contains_key(retrieved, i)), 1, most)
    sign = F.when(d == "increase", 1.0).otherwise(-1.0)
    agree = F.filter(known, lambda i: F.signum(retrieved[i]) == sign)
    size = lambda a: F.coalesce(F.size(a), F.lit(0))
    error = F.when(on & ~d.isin("increase", "decrease"), "no direction").when(on & (size(known) < 1), "no retrieved memories")
    applied = on & error.isNull() & (size(agree) > 0)
    s = alias(strength, STRENGTHS, keep=True)
    unsupported = on & error.isNull() & (size(agree) == 0)
    none = F.array().cast("array<string>")
    return F.struct(
        applied.alias("apply_correction"), F.when(applied, d).otherwise("none").alias("correction_direction"),
        F.when(applied, agree).otherwise(none).alias("selected_memory_ids"),
        F.when(~applied, "none").when(s.isin("weak", "moderate", "strong"), s).otherwise("moderate").alias("strength"),
        F.when(unsupported, NOT_SUPPORTED).otherwise(squeezed(F.coalesce(summary, F.when(on, "").otherwise(NO_MECHANISM)), 500)).alias("mechanism_summary"),
        F.coalesce(F.slice(F.filter(F.transform(evidence, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""), 1, 6), none).alias("evidence_fields"),
        confidence(conf).alias("confidence"), error.alias("error"),
    )


#: Summaries of gates that apply nothing.
NO_MECHANISM = "No supported residual mechanism."
NOT_SUPPORTED = "Selected memories did not empirically support the requested direction."


def vector(values: Column, lo: float = -2.0, hi: float = 2.0, whole: bool = False, size: int = 5) -> Column:
    """A vector of ``size`` limited numbers; null if the length differs or a number is missing."""
    v = F.transform(values, lambda x: clip(F.round(x) if whole else x, lo, hi))
    return F.when((F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)), v)


def prompt(instruction: str, base: Column, profile: Column, memories: Column | None = None) -> Column:
    """Instruction and a compact JSON of rounded base probability, profile and memories."""
    parts = [F.round(base, 1).alias("base_probability"), profile.alias("profile")]
    if memories is not None:
        parts.append(memories.alias("memories"))
    return F.concat(F.lit(instruction + "\n"), F.to_json(F.struct(*parts)))


def resolve_model(requested: str, available: list[str]) -> str:
    """Exact, then normalised, then unique partial match; otherwise raises."""
    norm = lambda s: "".join(ch for ch in s.lower().split("/")[-1] if ch.isalnum())
    if requested in available:
        return requested
    same = [a for a in available if norm(a) == norm(requested)]
    near = same or [a for a in available if norm(requested) in norm(a) or norm(a) in norm(requested)]
    if len(near) == 1 or same:
        return near[0]
    raise ValueError(f"no single model matches {requested}: {near or available}")


def migrate_log(log: DataFrame, new_hash: str, old_hashes: list[str]) -> DataFrame:
    """Records of old runs whose keys the new run lacks, under the new hash."""
    have = log.filter(F.col("config_hash") == new_hash).select("key").distinct()
    old = latest(log.filter(F.col("config_hash").isin(*old_hashes) & (F.col("status") == "ok")))
    return old.join(have, "key", "left_anti").withColumn("config_hash", F.lit(new_hash))
