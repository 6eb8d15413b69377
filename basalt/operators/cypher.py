"""A subset of Cypher over vertices and edges, compiled to joins.

MATCH (a:Label {k: v})-[r:TYPE]->(b)…, also <-[…]- and -[…]-, with *min..max; WHERE v.prop op literal AND …;
WITH and RETURN of variables (ids), v.prop, COUNT(*) and *, with AS, ORDER BY and LIMIT; CREATE; DELETE."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.operators.graph import variable_paths
from basalt.scratch import keep

#: Hops of a pattern without an upper bound (fixed value).
UNBOUNDED = 10
NODE = re.compile(r"\(\s*(\w*)\s*(?::\s*(\w+))?\s*(\{[^}]*\})?\s*\)")
EDGE = re.compile(r"(<?)-(?:\[\s*(\w*)\s*(?::\s*(\w+))?\s*(?:(\*)\s*(\d+)?\s*(\.\.)?\s*(\d+)?)?\s*\])?-(>?)")
CLAUSE = re.compile(r"\b((?:OPTIONAL\s+)?MATCH|WHERE|WITH|RETURN|ORDER\s+BY|LIMIT|CREATE|DELETE)\b", re.I)
COMPARE = re.compile(r"^\s*(\w+)\.(\w+)\s*(=|<>|<=|>=|<|>)\s*(.+?)\s*$")


def literal(text: str) -> object:
    if text[:1] in "'\"":
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    return float(text) if "." in text else int(text)


def properties(text: str | None) -> dict[str, object]:
    return {m[1]: literal(m[2]) for m in re.finditer(r"(\w+)\s*:\s*('[^']*'|\"[^\"]*\"|[^,}\s]+)", text or "")}


@dataclass
class Graph:
    vertices: DataFrame  # id, labels array<string>, props map<string,string>
    edges: DataFrame  # src, dst, type, props map<string,string>

    def prop(self, var: str, name: str) -> Column:
        return F.try_element_at(F.col(f"`{var}.props`"), F.lit(name))

    def node(self, var: str, label: str | None, props: dict[str, object]) -> DataFrame:
        v = self.vertices.filter(F.array_contains("labels", label)) if label else self.vertices
        for k, x in props.items():
            v = v.filter(F.try_element_at("props", F.lit(k)) == F.lit(str(x)))
        return v.select(F.col("id").alias(var), F.col("props").alias(f"{var}.props"))

    def condition(self, text: str) -> Column:
        out = F.lit(True)
        for part in re.split(r"\s+AND\s+", text.strip(), flags=re.I):
            m = COMPARE.match(part)
            if not m:
                raise ValueError(f"not a condition: {part}")
            var, name, op, value = m.groups()
            x, y = self.prop(var, name), literal(value)
            x = x.cast("double") if isinstance(y, (int, float)) and not isinstance(y, bool) else x
            y = F.lit(str(y).lower() if isinstance(y, bool) else y)
            out = out & {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
        return out

    def match(self, text: str, rows: DataFrame | None) -> DataFrame:
        for number, path in enumerate(re.split(r",(?=\s*\()", text)):
            at, prev = 0, None
            kind: tuple | None = None
            while m := NODE.match(path.strip(), at):
                var = m[1] or f"_n{number}_{at}"
                node = self.node(var, m[2], properties(m[3]))
                if prev is None:
                    rows = node if rows is None else rows if var in rows.columns else rows.crossJoin(node)
                else:
                    rows = self.expand(rows, prev, var, node, kind)
                prev, at = var, m.end()
                e = EDGE.match(path.strip(), at)
                if not e:
                    break
                kind, at = e.groups(), e.end()
        return rows

    def optional(self, text: str, where: str | None, rows: DataFrame | None) -> DataFrame:
        """Rows with what matches, and once with nulls those for which nothing does; without rows yet, one
        row of nulls if nothing matches at all. The WHERE behind it belongs to the pattern."""
        only = lambda found: found.filter(self.condition(where)) if where else found
        if rows is None:
            found = only(self.match(text, None))
            return found if not found.isEmpty() else found.sparkSession.createDataFrame([(None,) * len(found.columns)], found.schema)
        rows = keep(rows.withColumn("__row", F.monotonically_increasing_id()))
        found = only(self.match(text, rows))
        alone = rows.join(found.select("__row").distinct(), "__row", "left_anti")
        return found.unionByName(alone, allowMissingColumns=True).drop("__row")

    def expand(self, rows: DataFrame, a: str, b: str, node: DataFrame, kind: tuple) -> DataFrame:
        left, var, type_, star, least, dots, most, right = kind
        e = self.edges.filter(F.col("type") == type_) if type_ else self.edges
        if star:
            exact = least is not None and not dots
            lo, hi = int(least or 1), int(least if exact else most or UNBOUNDED)
            pairs = variable_paths(e, rows.select(F.col(a).alias("id")).distinct(), lo, hi)
            pairs = pairs.filter("source <> id").select(F.col("source").alias("__a"), F.col("id").alias("__b")).distinct()
            more = []
        else:
            more = [F.col("props").alias(f"{var}.props"), F.col("type").alias(var)] if var else []
            out = e.select(F.col("src").alias("__a"), F.col("dst").alias("__b"), *more)
            back = e.select(F.col("dst").alias("__a"), F.col("src").alias("__b"), *more)
            pairs = out if right else back if left else out.unionByName(back)
        rows = rows.join(pairs, F.col(a) == F.col("__a")).drop("__a")
        if b in rows.columns:
            return rows.filter(F.col("__b") == F.col(b)).drop("__b")
        return rows.join(node, F.col("__b") == F.col(b)).drop("__b")

    def project(self, rows: DataFrame, text: str) -> DataFrame:
        if text.strip() == "*":
            return rows.select(*[F.col(f"`{c}`") for c in rows.columns if not c.endswith(".props") and not c.startswith("_n")])
        keys, counts = [], []
        for item in text.split(","):
            m = re.match(r"^\s*(.+?)(?:\s+AS\s+(\w+))?\s*$", item, re.I)
            what, name = m[1], m[2] or m[1]
            if re.fullmatch(r"count\s*\(\s*\*\s*\)", what, re.I):
                counts.append(F.count("*").alias(m[2] or "count"))
            elif "." in what:
                keys.append(self.prop(*what.split(".")).alias(name))
            else:
                keys.append(F.col(what).alias(name))
        return rows.groupBy(*keys).agg(*counts) if counts else rows.select(*keys)

    def run(self, text: str) -> DataFrame | Graph:
        parts = CLAUSE.split(text)
        rows: DataFrame | None = None
        result: DataFrame | None = None
        clauses = [(re.sub(r"\s+", " ", w.upper()), b) for w, b in zip(parts[1::2], parts[2::2])]
        for i, (word, body) in enumerate(clauses):
            if word == "MATCH":
                rows = self.match(body.strip(), rows)
            elif word == "OPTIONAL MATCH":
                where = clauses[i + 1][1] if i + 1 < len(clauses) and clauses[i + 1][0] == "WHERE" else None
                rows = self.optional(body.strip(), where, rows)
            elif word == "WHERE" and clauses[i - 1][0] == "OPTIONAL MATCH":
                continue
            elif word == "WHERE":
                rows = rows.filter(self.condition(body))
            elif word == "WITH":
                kept = [c.strip() for c in body.split(",")]
                rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c in kept or c.removesuffix(".props") in kept])
            elif word == "RETURN":
                result = self.project(rows, body)
            elif word == "ORDER BY":
                order = [re.match(r"^\s*(\S+)(\s+DESC)?\s*$", x, re.I) for x in body.split(",")]
                result = result.orderBy(*[F.col(f"`{o[1]}`").desc() if o[2] else F.col(f"`{o[1]}`") for o in order])
            elif word == "LIMIT":
                result = result.limit(int(body))
            elif word == "CREATE":
                return self.create(body.strip())
            elif word == "DELETE":
                return self.delete(rows, body.strip())
        return result

    def create(self, text: str) -> Graph:
        """New nodes; ids are given as property id."""
        spark, nodes, edges, at, prev, kind = self.vertices.sparkSession, [], [], 0, None, None
        while m := NODE.match(text, at):
            p = properties(m[3])
            nodes.append((p["id"], [m[2]] if m[2] else [], {k: str(v) for k, v in p.items() if k != "id"}))
            if prev is not None:
                a, b = (p["id"], prev) if kind[0] else (prev, p["id"])
                edges.append((a, b, kind[2], {}))
            prev, at = p["id"], m.end()
            e = EDGE.match(text, at)
            if not e:
                break
            kind, at = e.groups(), e.end()
        v = self.vertices.unionByName(spark.createDataFrame(nodes, self.vertices.schema))
        return Graph(v, self.edges.unionByName(spark.createDataFrame(edges, self.edges.schema)) if edges else self.edges)

    def delete(self, rows: DataFrame, var: str) -> Graph:
        gone = rows.select(F.col(var).alias("id")).distinct()
        e = self.edges.join(gone, self.edges.src == gone.id, "left_anti").join(gone, F.col("dst") == gone.id, "left_anti")
        return Graph(self.vertices.join(gone, "id", "left_anti"), e)
