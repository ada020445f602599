"""Rule bitmask ledger: measure a text once, judge it under any policy later.

``measure`` reads every text once. ``ledger`` turns the measurements into one bit per failed
rule. A ``Policy`` is a named, versioned mask over those bits, so a new policy or an ablation
never reads a text again: verdicts are one AND per row, ablations one AND per distinct mask.

Defined results: a null text has no words and all counts 0; an empty text likewise; a text of
any length is measured whole; repeated rows are judged each on its own; an empty table gives
an empty ledger. Other columns of the input pass through; one that has the name of a column
made here is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchloom.llm.binding import restore, shield

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "dup_line_chars", "n_letters", "n_upper",
)
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the counts; true sets the rule's bit, null counts as passed."""

    name: str
    fails: str


#: A rule's place is its bit, for good: append rules, never reorder them.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_heavy", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    Rule("repeated_line_chars", "n_lines >= 4 and 100 * dup_line_chars > 30 * word_chars"),
    Rule("shouting", "n_letters >= 100 and 100 * n_upper > 50 * n_letters"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        places = {r.name: i for i, r in enumerate(rules)}
        return sum(1 << places[r] for r in set(self.rules))


BASE = Policy("base", 1, ("too_few_words", "repeated_windows"))
#: Earlier versions stay, so that their verdicts can be told again from any ledger.
STRICT = Policy("corpus", 1, tuple(r.name for r in RULES))
#: Without the share of repeated lines, which meets clean texts of a few short lines, and without long
#: words, which meets scripts that write no spaces.
CURRENT = Policy("corpus", 2, tuple(r.name for r in RULES if r.name not in ("repeated_lines", "long_words")))


def repeated_positions(ids: np.ndarray, size: int = 3) -> int:
    """Places covered by a window of ``size`` that occurs twice or more, first ones included."""
    n = len(ids)
    if n <= size:
        return 0
    code = ids[: n - size + 1]
    for k in range(1, size):
        part = ids[k : n - size + 1 + k]
        top = int(part.max()) + 1
        if int(code.max()) >= (1 << 62) // top:
            code = np.unique(code, return_inverse=True)[1]
        code = code * top + part
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(code), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(size):
        covered[k : n - size + 1 + k] |= twice
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at the six ASCII spaces and nothing else
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    once = set()
    dup_chars = n_dup = 0
    for x in lines:
        if x in once:
            n_dup += 1
            dup_chars += sum(len(w.decode("utf-8", "surrogatepass")) for w in x.split())
        once.add(x)
    upper = len(data) - len(data.translate(None, _UPPER))
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        len(data) - len(data.translate(None, _SYMBOLS)),
        n_dup,
        repeated_positions(ids),
        len(lines),
        dup_chars,
        upper + len(data) - len(data.translate(None, _LOWER)),
        upper,
    )


def counts(text: Column) -> Column:
    """Struct of ``COUNTS``; evaluated once per row, whatever reads its fields."""
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

    def batch(texts: pa.Array) -> pa.Array:
        found = [text_counts(x.as_py()) for x in texts]
        cols = zip(*found, strict=True) if found else [[] for _ in COUNTS]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], list(COUNTS))

    return F.arrow_udf(batch, kind).asNondeterministic()(text.cast("string"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one column per count."""
    inner, at = shield(docs)
    return restore(inner.withColumn("found", counts(at[text])), at, **{c: F.col(f"found.{c}") for c in COUNTS})


def fail_mask(rules: tuple[Rule, ...] = RULES, struct: str = "") -> Column:
    """One bit per failed rule, from counts that are columns or fields of ``struct``."""
    mask = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        sql = " ".join(f"{struct}.{w}" if struct and w in COUNTS else w for w in r.fails.split())
        mask = mask.bitwiseOR(F.when(F.expr(sql), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return mask


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measure`` and ``fail_mask``: all that policies and ablations need."""
    return measure(docs, text).withColumn("fail_mask", fail_mask(rules))


def passes(policy: Policy, mask: str = "fail_mask", rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col(mask).bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ablation(judged: DataFrame, policies: list[Policy], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule: rows failing it, rows only it rejects, rows kept with and without it.

    ``judged`` shrinks to one count per distinct mask before anything else is done.
    """
    masks = judged.groupBy("fail_mask").agg(F.count(F.lit(1)).alias("n"))
    cells = [(p.name, p.version, r, p.mask(rules), Policy("", 0, (r,)).mask(rules)) for p in policies for r in p.rules]
    grid = F.array(
        *[
            F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(c, ("string", "int", "string", "long", "long"), ("policy", "version", "rule", "mask", "bit"), strict=True)])
            for c in cells
        ]
    )
    each = masks.select("n", "fail_mask", F.explode(grid).alias("c")).select("n", "fail_mask", "c.*")
    failed = F.col("fail_mask").bitwiseAND(F.col("mask"))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).alias
    return each.groupBy("policy", "version", "rule").agg(
        total(failed.bitwiseAND(F.col("bit")) != 0)("n_failing"),
        total(failed == F.col("bit"))("n_sole"),
        total(failed == 0)("n_kept"),
        total((failed == 0) | (failed == F.col("bit")))("n_kept_without"),
    )


def keep_good(docs: DataFrame, text: str = "text", policy: Policy = CURRENT) -> DataFrame:
    """The rows of ``docs`` that ``policy`` keeps, unchanged."""
    inner, at = shield(docs)
    judged = inner.withColumn("found", counts(at[text])).withColumn("mask", fail_mask(RULES, "found"))
    return restore(judged.filter(passes(policy, "mask")), at)


def op1_quality_ledger(spark, sf_dir: str) -> DataFrame:
    """One row per document: counts, failure bits, base verdict and verdict of the current policy."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = ledger(docs)
    mine = F.col("fail_mask").bitwiseAND(F.lit(CURRENT.mask()).cast("long"))
    base_failed = ~passes(BASE)
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & passes(CURRENT)).alias("kept"),
        "fail_mask",
        passes(STRICT).alias("kept_v1"),
        F.when(F.bit_count(mine) == 1, mine).alias("sole_rule_bit"),
    )


def _sql() -> str:
    bits = " + ".join(f"case when {r.fails} then {1 << i} else 0 end" for i, r in enumerate(RULES))
    base, strict, current = BASE.mask(), STRICT.mask(), CURRENT.mask()
    return rf"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws from d),
win as (
  select doc_id, i, count(*) over (partition by doc_id, key) c
  from (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as key
        from (select doc_id, ws, unnest(generate_series(1, len(ws) - 2)) i from w))),
rep as (select doc_id, count(distinct p) n from (select doc_id, unnest([i, i + 1, i + 2]) p from win where c > 1) group by 1),
ln as (
  select doc_id, row_number() over (partition by doc_id, l order by k) r, l,
         length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) nc
  from (select doc_id, unnest(string_split(t, chr(10))) l, unnest(generate_series(1, len(string_split(t, chr(10))))) k from d)
  where regexp_matches(l, '[^\x20\x09-\x0D]')),
dup as (select doc_id, count(*) n_lines, count(*) filter (where r > 1) n_dup_lines,
               coalesce(sum(nc) filter (where r > 1), 0) dup_line_chars from ln group by 1),
m as (
  select w.doc_id, len(ws) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols,
         coalesce(n_dup_lines, 0) n_dup_lines, coalesce(rep.n, 0) n_repeat_words, coalesce(n_lines, 0) n_lines,
         coalesce(dup_line_chars, 0) dup_line_chars,
         length(regexp_replace(t, '[^A-Za-z]', '', 'g')) n_letters, length(regexp_replace(t, '[^A-Z]', '', 'g')) n_upper
  from w left join rep using (doc_id) left join dup using (doc_id)),
f as (select *, cast({bits} as bigint) fail_mask from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_mask & {base}) <> 0 base_failed,
       (fail_mask & {base}) = 0 and (fail_mask & {current}) = 0 kept, fail_mask, (fail_mask & {strict}) = 0 kept_v1,
       case when bit_count(fail_mask & {current}) = 1 then fail_mask & {current} end sole_rule_bit
from f
"""


OP1_SQL = _sql()
