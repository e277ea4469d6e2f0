"""Domain tables derived from the test tables, the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skills(spark: SparkSession, d: str) -> DataFrame:
    """(id, uid, category, vector, is_deprecated, execution_success_rate, version, description)."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.expr("concat('ns', label, ':s', vec_id)").alias("uid"),
        F.col("label").alias("category"),
        F.col("embedding").alias("vector"),
        F.expr("vec_id % 17 = 0").alias("is_deprecated"),
        F.expr("1.0D - (vec_id % 7) * 0.1D").alias("execution_success_rate"),
        F.expr("concat('skill ', vec_id, ' of category ', label, ' does step ', vec_id % 9)").alias("description"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, edge_type, weight): acyclic REQUIRES, and the other types by modular rules."""
    v = table(spark, d, "embeddings").select("vec_id", "label")
    n = v.agg(F.count("*").alias("n"))
    one = v.where("vec_id > 0").selectExpr("vec_id source", "vec_id div 2 target", "'REQUIRES' edge_type", "1.0D weight")
    two = v.where("vec_id > 5 and vec_id % 3 = 0").selectExpr("vec_id source", "vec_id div 3 target", "'REQUIRES' edge_type", "0.7D weight")
    three = v.where("vec_id % 4 = 1").join(F.broadcast(n)).selectExpr("vec_id source", "(vec_id * 13 + 5) % n target", "'ENHANCES' edge_type", "0.8D weight").where("source <> target")
    a, b = v.toDF("a", "label"), v.toDF("b", "label")
    pairs = a.join(b, "label").where("a < b")
    four = pairs.where("(a * 31 + b * 17) % 23 = 0").selectExpr("a source", "b target", "'CONFLICTS_WITH' edge_type", "1.0D weight")
    five = pairs.where("(a + b) % 29 = 0").selectExpr("a source", "b target", "'SUBSTITUTES' edge_type", "0.9D weight")
    return one.unionByName(two).unionByName(three).unionByName(four).unionByName(five)


def requires(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).where("edge_type = 'REQUIRES'").select("source", "target")


def cyclic(spark: SparkSession, d: str) -> DataFrame:
    """(source, target): halving edges with some two-node cycles."""
    v = table(spark, d, "embeddings").select("vec_id")
    down = v.where("vec_id > 0").selectExpr("vec_id source", "vec_id div 2 target")
    up = v.where("vec_id % 50 = 1 and vec_id > 1").selectExpr("vec_id div 2 source", "vec_id target")
    return down.unionByName(up).where("source <> target")


def requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 25 = 0").selectExpr("vec_id request_id", "embedding query_vector")


def executions(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, ts, session_id, skill_id, ok, duration_ms)."""
    n = table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    return table(spark, d, "events").join(F.broadcast(n)).selectExpr("event_id", "ts", "user_id session_id", "(user_id * 37 + event_id) % n skill_id", "event_type <> 'error' ok", "value duration_ms")


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored and current (path, hash) of files."""
    p = table(spark, d, "pages").selectExpr("page_id", "cast(page_id as string) path", "md5(html) hash", "html")
    new = p.select("path", "hash")
    old = p.where("page_id % 7 <> 0").selectExpr("path", "case when page_id % 11 = 0 then md5(concat(html, 'x')) else hash end hash")
    gone = p.where("page_id % 13 = 0").selectExpr("cast(page_id + 1000000 as string) path", "hash")
    return old.unionByName(gone), new


def permissions(spark: SparkSession, d: str) -> DataFrame:
    """(id, permission): declared permissions, some of them malformed, by rules on part keys."""
    return table(spark, d, "part").selectExpr(
        "p_partkey id",
        """explode(filter(array(
             concat(element_at(array('fs', 'net', 'db', 'exec', 'env', 'secret', 'system', 'custom'), cast(p_partkey % 8 + 1 as int)), ':',
                    element_at(array('read', 'write', 'delete', 'execute', 'list', 'admin'), cast(p_partkey % 6 + 1 as int)),
                    case when p_partkey % 3 = 0 then ':/' when p_partkey % 3 = 1 then concat(':t', p_partkey % 10) else '' end),
             case when p_partkey % 4 = 0 then 'net:github.com' when p_partkey % 4 = 1 then concat('fs:write:/data/', p_partkey % 5) end,
             case when p_partkey % 5 = 0 then concat('fs:delete:/data/', p_partkey % 5) when p_partkey % 5 = 1 then 'exec:execute' end
             , case when p_partkey % 10 = 3 then concat('net:write:h', p_partkey div 50) when p_partkey % 10 = 7 then concat('net:execute:h', p_partkey div 50)
                    when p_partkey % 10 = 9 then concat('db:read:h', p_partkey div 50) when p_partkey % 10 = 1 then concat('db:delete:h', p_partkey div 50) end
           ), x -> x is not null)) permission""",
    )


#: Code of seven languages by rules on part keys, in SQL that both engines read.
CODE = """case p_partkey % 7
    when 0 then concat('import os', chr(10), 'from a.b import c', chr(10), repeat(concat('def f(a, b):', chr(10), '    return a', chr(10)), cast(p_partkey % 3 as int)),
        case when p_partkey % 2 = 0 then concat('def main(x):', chr(10), '    ', repeat(chr(34), 3), 'doc', repeat(chr(34), 3), chr(10), '    y = 1', chr(10)) else concat('z = 2', chr(10)) end)
    when 1 then concat(case when p_partkey % 2 = 0 then concat('set -e', chr(10)) else '' end, repeat(concat('echo $A b', chr(10)), cast(p_partkey % 4 as int)), 'run() {', chr(10), '  x=1', chr(10), '}', chr(10))
    when 2 then concat('const fs = require("fs");', chr(10), repeat(concat('console.log(1);', chr(10)), cast(p_partkey % 4 as int)), 'const go = async (a, b) => {', chr(10), '  return a;', chr(10), '}', chr(10))
    when 3 then concat('import x from "m"', chr(10), 'export function handler(a: any, b: number): void {', chr(10), '  let q: any = 1;', chr(10), '}', chr(10))
    when 4 then concat('import (', chr(10), '  "os"', chr(10), '  "fmt"', chr(10), ')', chr(10), 'func (s *S) Run(a int) error {', chr(10), '  v, err := f()', chr(10), case when p_partkey % 2 = 0 then concat('  if err != nil { return err }', chr(10)) else '' end, '}', chr(10))
    when 5 then concat('use a::b;', chr(10), 'pub async fn execute(a: u8) -> u8 {', chr(10), '  let mut n = 1;', chr(10), repeat(concat('  unsafe { n += 1; }', chr(10)), cast(p_partkey % 3 as int)), '}', chr(10))
    else concat('import a.B;', chr(10), 'class A {', chr(10), '  A(int x) { }', chr(10), '  public static int run(int a, String b) {', chr(10), '    int c = 1;', chr(10), '    try { f(); } catch (E e) { }', chr(10), '    return c;', chr(10), '  }', chr(10), '}', chr(10)) end"""
LANGUAGES = "case p_partkey % 7 when 0 then 'python' when 1 then 'bash' when 2 then 'javascript' when 3 then 'typescript' when 4 then 'go' when 5 then 'rust' else 'java' end"


def code(spark: SparkSession, d: str) -> DataFrame:
    """(id, language, code, line_start)."""
    return table(spark, d, "part").selectExpr("p_partkey id", f"{LANGUAGES} language", f"{CODE} code", "cast(p_partkey % 5 + 1 as int) line_start")


#: The same tables as DuckDB common table expressions.
CTE = {
    "code": f"code AS (SELECT p_partkey AS id, {LANGUAGES} AS language, {CODE} AS code, (p_partkey % 5 + 1)::INT AS line_start FROM part)",
    "skills": """skills AS (SELECT vec_id AS id, 'ns' || label || ':s' || vec_id AS uid, label AS category, embedding AS vector, vec_id % 17 = 0 AS is_deprecated,
        1.0::DOUBLE - (vec_id % 7) * 0.1::DOUBLE AS execution_success_rate, 'skill ' || vec_id || ' of category ' || label || ' does step ' || (vec_id % 9) AS description FROM embeddings)""",
    "edges": """n AS (SELECT count(*) AS n FROM embeddings), edges AS (
        SELECT vec_id AS source, vec_id // 2 AS target, 'REQUIRES' AS edge_type, 1.0::DOUBLE AS weight FROM embeddings WHERE vec_id > 0
        UNION ALL SELECT vec_id, vec_id // 3, 'REQUIRES', 0.7 FROM embeddings WHERE vec_id > 5 AND vec_id % 3 = 0
        UNION ALL SELECT vec_id, (vec_id * 13 + 5) % n, 'ENHANCES', 0.8 FROM embeddings, n WHERE vec_id % 4 = 1 AND vec_id <> (vec_id * 13 + 5) % n
        UNION ALL SELECT a.vec_id, b.vec_id, 'CONFLICTS_WITH', 1.0 FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE (a.vec_id * 31 + b.vec_id * 17) % 23 = 0
        UNION ALL SELECT a.vec_id, b.vec_id, 'SUBSTITUTES', 0.9 FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE (a.vec_id + b.vec_id) % 29 = 0)""",
    "requests": "requests AS (SELECT vec_id AS request_id, embedding AS query_vector FROM embeddings WHERE vec_id % 25 = 0)",
    "cyclic": """cyclic AS (SELECT vec_id AS source, vec_id // 2 AS target FROM embeddings WHERE vec_id > 0
        UNION ALL SELECT vec_id // 2, vec_id FROM embeddings WHERE vec_id % 50 = 1 AND vec_id > 1)""",
    "executions": """executions AS (SELECT event_id, ts, user_id AS session_id, (user_id * 37 + event_id) % (SELECT count(*) FROM embeddings) AS skill_id,
        event_type <> 'error' AS ok, value AS duration_ms FROM events)""",
    "snapshots": """snap_new AS (SELECT page_id::VARCHAR AS path, md5(html) AS hash FROM pages), snap_old AS (
        SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 11 = 0 THEN md5(html || 'x') ELSE md5(html) END AS hash FROM pages WHERE page_id % 7 <> 0
        UNION ALL SELECT (page_id + 1000000)::VARCHAR, md5(html) FROM pages WHERE page_id % 13 = 0)""",
    "permissions": """raw AS (SELECT p_partkey AS id, (['fs', 'net', 'db', 'exec', 'env', 'secret', 'system', 'custom'])[p_partkey % 8 + 1] || ':'
          || (['read', 'write', 'delete', 'execute', 'list', 'admin'])[p_partkey % 6 + 1]
          || CASE p_partkey % 3 WHEN 0 THEN ':/' WHEN 1 THEN ':t' || (p_partkey % 10) ELSE '' END AS permission FROM part
        UNION ALL SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'net:github.com' ELSE 'fs:write:/data/' || (p_partkey % 5) END FROM part WHERE p_partkey % 4 < 2
        UNION ALL SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'fs:delete:/data/' || (p_partkey % 5) ELSE 'exec:execute' END FROM part WHERE p_partkey % 5 < 2
        UNION ALL SELECT p_partkey, CASE p_partkey % 10 WHEN 3 THEN 'net:write:h' WHEN 7 THEN 'net:execute:h' WHEN 9 THEN 'db:read:h' ELSE 'db:delete:h' END || (p_partkey // 50) FROM part WHERE p_partkey % 10 IN (1, 3, 7, 9)),
        permissions AS (SELECT id, permission FROM raw)""",
}


def with_(*names: str, recursive: bool = False) -> str:
    """The WITH clause of these tables."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(CTE[n] for n in names)}"
