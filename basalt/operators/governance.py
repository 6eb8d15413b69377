"""Compliance and statistics: personal data, differential privacy, retention, deletion plans, distributions."""

from __future__ import annotations

import re
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in column names that hint at a category, and how sure they are.
NAME_HINTS: list[tuple[str, float, str]] = [
    ("Email", 0.8, "email e_mail e-mail email_address"),
    ("Phone", 0.8, "phone telephone mobile cell phone_number"),
    ("Ssn", 0.9, "ssn social_security social-security"),
    ("CreditCard", 0.8, "credit_card creditcard cc_number card_number"),
    ("IpAddress", 0.7, "ip_address ip_addr ipaddress ip"),
    ("Name", 0.7, "first_name last_name full_name firstname lastname fullname name"),
    ("Address", 0.7, "address street addr street_address"),
    ("DateOfBirth", 0.8, "dob date_of_birth birth_date birthday birthdate"),
    ("Financial", 0.7, "salary income bank_account account_number routing_number iban"),
    ("Medical", 0.7, "diagnosis medical_record prescription icd_code health"),
]
#: What values look like, and how sure that is.
VALUE_PATTERNS: list[tuple[str, float, str]] = [
    ("Email", 0.9, r"^[^@]+@(?=.{3,})[^@]*\.[^@]*$"),
    ("Ssn", 0.95, r"^\d{3}-\d{2}-\d{4}$"),
    ("CreditCard", 0.9, r"^\d(?:[ -]?\d){12,18}$"),
    ("Phone", 0.85, r"^\+?[() .-]*(?:\d[() .-]*){10,15}$"),
    ("IpAddress", 0.9, r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"),
]


def name_hints(column: str) -> dict[str, float]:
    low = column.lower()
    parts = re.split("[_-]", low)
    hit = lambda k: k == low or k in parts or (len(k) > 3 and k in low)
    return {c: sure for c, sure, keys in NAME_HINTS if any(map(hit, keys.split()))}


def pii_categories(value: Column) -> Column:
    """Categories whose pattern a value matches."""
    found = F.array(*[F.when(value.rlike(p), F.lit(c)) for c, _, p in VALUE_PATTERNS])
    return F.filter(found, lambda c: c.isNotNull())


def pii_scan(rows: DataFrame) -> DataFrame:
    """(column, category, confidence, matches) over the text columns of a whole table in one pass."""
    text = [c for c, t in rows.dtypes if t == "string"]
    sure = {(c, p[0]): p[1] for c in text for p in VALUE_PATTERNS}
    counts = rows.agg(*[F.count_if(F.col(c).rlike(p)).alias(f"{c}|{k}") for c in text for k, _, p in VALUE_PATTERNS])
    pairs = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("category"), F.lit(s).alias("confidence"), F.col(f"`{c}|{k}`").alias("matches")) for (c, k), s in sure.items()]
    hints = [(c, k, s, 0) for c in rows.columns for k, s in name_hints(c).items()]
    found = counts.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter("matches > 0")
    if hints:
        found = found.unionByName(rows.sparkSession.createDataFrame(hints, "column string, category string, confidence double, matches long"))
    return found.groupBy("column", "category").agg(F.max("confidence").alias("confidence"), F.max("matches").alias("matches"))


def laplace(scale: float, seed: int | None = None) -> Column:
    u = F.rand(seed) - 0.5
    return -F.lit(scale) * F.signum(u) * F.log1p(-2 * F.abs(u))


def private(rows: DataFrame, kind: str, column: str | None, epsilon: float, sensitivity: float = 1.0, delta: float | None = None, seed: int | None = None) -> DataFrame:
    """count, sum or avg with Laplace noise of scale sensitivity/ε, or with a δ Gaussian noise."""
    value = {"count": F.count("*"), "sum": F.sum(column or F.lit(0)), "avg": F.avg(column or F.lit(0))}[kind]
    noise = laplace(sensitivity / epsilon, seed) if delta is None else F.randn(seed) * (sensitivity * sqrt(2 * log(1.25 / delta)) / epsilon)
    return rows.agg(value.cast("double").alias("exact")).select((F.col("exact") + noise).alias(kind))


def expired(rows: DataFrame, ts: str, days: int, now: Column) -> DataFrame:
    return rows.filter(F.col(ts) < now - F.expr(f"INTERVAL '{int(days)}' DAY"))


def deletion_plan(references: dict[str, list[str]], table: str) -> list[str]:
    """Tables in the order to delete from: those that refer to `table`, over any number of steps, before
    what they refer to. `references` gives for each table those it refers to."""
    children: dict[str, list[str]] = {}
    for child, parents in references.items():
        for p in parents:
            children.setdefault(p, []).append(child)
    out: list[str] = []

    def visit(t: str, path: tuple[str, ...]) -> None:
        for c in sorted(children.get(t, [])):
            if c not in path:
                visit(c, (*path, c))
        if t not in out:
            out.append(t)

    visit(table, (table,))
    return out


def distribution(rows: DataFrame, outcome: str) -> DataFrame:
    """(outcome, p)."""
    n = rows.groupBy(F.col(outcome).alias("outcome")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select("outcome", (F.col("n") / F.col("all")).alias("p"))


def entropy(dist: DataFrame) -> DataFrame:
    return dist.agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"))


def divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """(kl, total_variation, fidelity) of two distributions; kl is infinite where b lacks an outcome of a."""
    both = a.withColumnRenamed("p", "x").join(b.withColumnRenamed("p", "y"), "outcome", "full").na.fill(0.0, ["x", "y"])
    kl = F.when(F.col("x") > 0, F.when(F.col("y") > 0, F.col("x") * F.log2(F.col("x") / F.col("y"))).otherwise(F.lit(float("inf")))).otherwise(0.0)
    return both.agg(F.sum(kl).alias("kl"), (F.sum(F.abs(F.col("x") - F.col("y"))) / 2).alias("total_variation"), F.pow(F.sum(F.sqrt(F.col("x") * F.col("y"))), 2).alias("fidelity"))


def blob_chunks(blobs: DataFrame, key: str, data: str, size: int) -> DataFrame:
    """(key, n, hash, bytes): content-addressed chunks of binary values."""
    n = F.ceil(F.octet_length(data) / size).cast("int")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("n")
    cut = blobs.select(F.col(key).alias("key"), F.col(data).alias("d"), at)
    return cut.select("key", "n", F.substring("d", F.col("n") * size + 1, F.lit(size)).alias("chunk")).select("key", "n", F.sha2("chunk", 256).alias("hash"), F.octet_length("chunk").alias("bytes"))


def dedup_ratio(chunks: DataFrame) -> DataFrame:
    """Logical bytes by bytes of distinct chunks."""
    each = chunks.groupBy("hash").agg(F.count("*").alias("n"), F.first("bytes").alias("bytes"))
    return each.agg((F.sum(F.col("n") * F.col("bytes")) / F.sum("bytes")).alias("ratio"))
