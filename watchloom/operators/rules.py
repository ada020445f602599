"""Rule engine: checks over inventory tables, reported per rule with offending rows as detail."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.numbers import tier
from watchloom.operators.filters import only_issues

# Result wording per report language.
LABELS = {
    "en": {"ok": "OK", "issue": "Possible issue found", "unsupported": "Not supported"},
    "pt": {"ok": "OK", "issue": "Possível problema encontrado", "unsupported": "Não suportado"},
}


@dataclass(frozen=True)
class Rule:
    """One check.

    A row rule gives ``where``: offending rows of ``table``. A set rule gives ``build``: a
    function from the tables to the frame of offending rows. ``needs`` names the tables a
    set rule reads; with any missing, the result is "not supported".
    """

    code: int
    category: str
    title: str
    table: str | None = None
    where: str | None = None
    build: Callable[[dict[str, DataFrame]], DataFrame] | None = None
    needs: tuple[str, ...] = ()
    detail: tuple[str, ...] = ()
    how_to_fix: str = ""
    labels: dict = field(default_factory=dict)


def _supported(rule: Rule, tables: dict[str, DataFrame]) -> bool:
    if rule.build is not None:
        return all(n in tables for n in rule.needs)
    return rule.table in tables


def _row_rules(tables: dict[str, DataFrame], rules: list[Rule]) -> dict[str, list[Rule]]:
    grouped: dict[str, list[Rule]] = {}
    for r in rules:
        if r.build is None and _supported(r, tables):
            grouped.setdefault(r.table, []).append(r)
    return grouped


def count_violations(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """(code, issues). All row rules on one table are counted in a single scan of it."""
    parts = []
    for name, group in _row_rules(tables, rules).items():
        counts = tables[name].agg(*[F.count_if(F.expr(r.where)).alias(f"r{r.code}") for r in group])
        pairs = F.array(*[F.struct(F.lit(r.code).alias("code"), F.col(f"r{r.code}").alias("issues")) for r in group])
        parts.append(counts.select(F.inline(pairs)))
    for r in rules:
        if r.build is not None and _supported(r, tables):
            found = r.build(tables).agg(F.count(F.lit(1)).alias("issues"))
            parts.append(found.select(F.lit(r.code).alias("code"), "issues"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_rules(tables: dict[str, DataFrame], rules: list[Rule], issues_only: bool = True, language: str = "en") -> DataFrame:
    """(code, category, title, result, issues, how_to_fix) per rule, in code order."""
    words = LABELS[language]
    spark = next(iter(tables.values())).sparkSession
    # one row per rule
    meta = spark.createDataFrame(
        [(r.code, r.category, r.labels.get(language, r.title), r.how_to_fix) for r in rules],
        "code int, category string, title string, how_to_fix string",
    )
    counted = meta.join(count_violations(tables, rules), "code", "left")
    n = F.col("issues")
    result = (
        F.when(n.isNull(), words["unsupported"])
        .when(n == 0, words["ok"])
        .otherwise(F.concat(F.lit(words["issue"] + " ("), n.cast("string"), F.lit(")")))
    )
    out = counted.withColumn("result", result).select("code", "category", "title", "result", "issues", "how_to_fix").orderBy("code")
    return only_issues(out) if issues_only else out


def rule_details(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """(code, detail json): every offending row, one scan per table for its row rules."""

    def as_json(cols) -> Column:
        return F.to_json(F.struct(*cols)) if cols else F.to_json(F.struct("*"))

    parts = []
    for name, group in _row_rules(tables, rules).items():
        hits = [
            F.when(F.expr(r.where), F.struct(F.lit(r.code).alias("code"), as_json(r.detail).alias("detail"))) for r in group
        ]
        kept = F.filter(F.array(*hits), lambda h: h.isNotNull())
        parts.append(tables[name].select(F.inline(kept)))
    for r in rules:
        if r.build is not None and _supported(r, tables):
            parts.append(r.build(tables).select(F.lit(r.code).alias("code"), as_json(r.detail).alias("detail")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exists_rule(code: int, category: str, title: str, table: str, condition: str, servers: str = "servers") -> Rule:
    """Violated by each server of the ``servers`` table without a row of ``table`` that meets the condition."""

    def build(tables):
        held = tables[table].where(condition).select("server").distinct()
        return tables[servers].select("server").distinct().join(held, "server", "left_anti")

    return Rule(code, category, title, build=build, needs=(table, servers), detail=("server",))


def range_rule(code: int, category: str, title: str, table: str, checks: dict[str, tuple], detail=()) -> Rule:
    """Violated by rows with any column outside its (low, high); None leaves a side open."""
    bad = []
    for col, (low, high) in checks.items():
        if low is not None:
            bad.append(f"{col} < {low}")
        if high is not None:
            bad.append(f"{col} > {high}")
    return Rule(code, category, title, table, " OR ".join(bad), detail=tuple(detail))


def constraint_rules(tables: dict[str, DataFrame], spec: list[dict]) -> DataFrame:
    """(rule, kind, violations) for declared constraints.

    Spec entries: ``enum`` (table, column, values), ``unique`` (table, columns, optional
    where: offending keys are counted) and ``foreign_key`` (table, column, parent, key:
    rows without parent, nulls allowed). ``once`` is unique over non-null values.
    """
    parts = []
    for s in spec:
        df = tables[s["table"]]
        if s.get("where"):
            df = df.where(s["where"])
        kind = s["kind"]
        if kind == "enum":
            c = F.col(s["column"])
            found = df.agg(F.count_if(c.isNotNull() & ~c.isin(list(s["values"]))).alias("violations"))
        elif kind in ("unique", "once"):
            if kind == "once":
                df = df.dropna(subset=list(s["columns"]))
            found = df.groupBy(*s["columns"]).count().agg(F.count_if(F.col("count") > 1).alias("violations"))
        elif kind == "foreign_key":
            keys = tables[s["parent"]].select(F.col(s["key"]).alias(s["column"])).distinct()
            # references are counted per key first, so a hot key joins as one row
            refs = df.where(F.col(s["column"]).isNotNull()).groupBy(s["column"]).count()
            found = refs.join(keys, s["column"], "left_anti").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("violations"))
        else:
            raise ValueError(f"unknown constraint kind {kind!r}")
        parts.append(found.select(F.lit(s["name"]).alias("rule"), F.lit(kind).alias("kind"), F.col("violations").cast("long")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Commonly guessed secrets.
COMMON_SECRETS = [
    "teste", "TESTE", "password", "qwerty", "football", "baseball", "welcome", "abc123",
    "1qaz2wsx", "dragon", "master", "monkey", "letmein", "login", "princess", "qwertyuiop",
    "solo", "passw0rd", "starwars", "teste123", "TESTE123", "deuseamor", "jesuscristo",
    "iloveyou", "MARCELO", "jc2512", "maria", "jose", "batman", "123123", "123123123",
    "FaMiLia", "", " ", "sexy", "abel123", "freedom", "whatever", "qazwsx", "trustno1",
    "sucesso", "1q2w3e4r", "1qazxsw2", "zaq12wsx", "! qaz2wsx", "!qaz2wsx", "123mudar",
    "gabriel", "102030", "010203", "101010", "131313", "vitoria", "flamengo", "felipe",
    "brasil", "felicidade", "mariana",
]


def secret_candidates(names: DataFrame) -> DataFrame:
    """(word): common secrets, repeated digits and characters, digit runs, names in three
    spellings, and everything reversed."""
    spark = names.sparkSession
    times = F.explode(F.sequence(F.lit(1), F.lit(9))).alias("k")
    common = spark.createDataFrame([(w,) for w in COMMON_SECRETS], "word string")
    codes = spark.range(12, 126).select(F.chr("id").alias("c")).unionByName(spark.range(1, 10).select(F.col("id").cast("string").alias("c")))
    repeated = codes.select("c", times).select(F.expr("repeat(c, k)").alias("word"))
    runs = spark.range(1, 12).select(F.substring(F.lit("01234567890"), 1, F.col("id").cast("int")).alias("word"))
    runs = runs.unionByName(spark.range(1, 11).select(F.substring(F.lit("1234567890"), 1, F.col("id").cast("int")).alias("word")))
    name = F.col(names.columns[0])
    spelled = names.select(F.explode(F.array(name, F.lower(name), F.upper(name))).alias("word"))
    words = common.unionByName(repeated).unionByName(runs).unionByName(spelled)
    return words.select(F.explode(F.array(F.col("word"), F.reverse("word"))).alias("word")).distinct()


def dictionary_match(df: DataFrame, hash_col: str, words: DataFrame) -> DataFrame:
    """Rows whose unsalted SHA-256 equals that of a candidate word: one hash per word, one equi-join."""
    hashed = words.select("word", F.sha2(F.col("word"), 256).alias(hash_col))
    return df.join(hashed, hash_col)


FRAGMENTATION_BANDS = (5, 30, 50)
HUGE_MB, HUGE_FRAGMENTED_MB, HUGE_FRAGMENTED_ROWS = 400, 80, 500_000
MIN_PAGES = 9
# Upper row bound (exclusive) and sample size of each step.
SAMPLE_STEPS = [
    (500_000, "100 PERCENT"), (1_000_000, "50 PERCENT"), (5_000_000, "25 PERCENT"),
    (10_000_000, "10 PERCENT"), (50_000_000, "2 PERCENT"), (100_000_000, "1 PERCENT"),
]


def table_advisor(stats: DataFrame, detect_huge: bool = True) -> DataFrame:
    """Maintenance advice per (table, partition).

    ``stats``: (fragmentation, pages, rows, modified, stored_type, is_columnstore,
    allow_page_locks). Adds ``action`` (REORGANIZE, REBUILD, ATTENTION, NONE), the free-space
    target and the statistics sample; small objects are left out.
    """
    low, mid, high = FRAGMENTATION_BANDS
    s = stats.where(F.col("pages") >= MIN_PAGES).withColumn("size_mb", F.col("pages") * 8 / 1024.0)
    f = F.col("fragmentation")
    huge = (
        (F.col("stored_type") != "LOB_DATA")
        & (F.col("size_mb") > HUGE_MB)
        & (F.col("size_mb") * f > HUGE_FRAGMENTED_MB)
        & (F.col("rows") * f > HUGE_FRAGMENTED_ROWS)
    )
    tidy = f.between(low, mid) | (huge if detect_huge else F.lit(False))
    can_reorganize = F.col("allow_page_locks") | F.col("is_columnstore")
    action = (
        F.when(tidy & can_reorganize, "REORGANIZE")
        .when(tidy, "ATTENTION")
        .when((f > mid) & F.col("is_columnstore"), "REORGANIZE")
        .when(f > mid, "REBUILD")
        .otherwise("NONE")
    )
    volume = F.coalesce("rows", F.lit(0)) + F.coalesce("modified", F.lit(0))
    sample = tier(volume, [b - 1 for b, _ in SAMPLE_STEPS], [label for _, label in SAMPLE_STEPS] + ["3000000 ROWS"])
    return s.withColumns(
        {
            "action": action,
            "fill_factor": F.when(f <= mid, 100).when(f <= high, 90).otherwise(70),
            "sample": F.when((F.col("rows") > 100) & (F.col("modified") > 0), sample),
        }
    )
