"""The citation model, as tables of its own or read out of a star schema.

``MODEL`` defines each model table by SQL that Spark and DuckDB both read, so that an oracle can stand on the
same rows. Inside the engine places are arrays of (type, value); the wide columns are for interchange only.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.places import parts_of

_CITATION = "l_orderkey * 8 + l_linenumber"
_ON_PAGE = "(l_orderkey + l_linenumber) % 4 = 0"
_NUMBERS = "(VALUES (1), (2), (3), (4)) AS v(n)"

MODEL: dict[str, str] = {
    "m_books": """SELECT 'b' || CAST(p_partkey AS STRING) AS id, p_name AS title, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand END AS author,
        CASE WHEN p_partkey % 3 = 0 THEN 'tr. ' || p_type END AS translator, CAST(p_size AS BIGINT) AS author_id FROM {part}""",
    "m_authors": "SELECT DISTINCT CAST(p_size AS BIGINT) AS id, 'Writer ' || CAST(p_size AS STRING) AS name FROM {part}",
    "m_author_names": """SELECT id * 10 AS id, id AS author_id, name FROM {m_authors}
        UNION ALL SELECT id * 10 + 1 AS id, id AS author_id, 'W. the ' || CAST(id AS STRING) || 'th' AS name FROM {m_authors} WHERE id % 2 = 0""",
    "m_alternate_ids": "SELECT 'b' || CAST(p_partkey AS STRING) AS book_id, 'alt' || CAST(p_partkey % 97 AS STRING) AS alternate_id FROM {part} WHERE p_partkey % 20 = 0",
    "m_checks": """SELECT event_id AS id, 'b' || CAST(user_id AS STRING) AS book_id, CASE event_type WHEN 'click' THEN 'probably_public_domain' WHEN 'error' THEN 'likely_copyrighted'
        WHEN 'signup' THEN 'doubtful_public_domain' ELSE 'likely_public_domain' END AS status, 'note ' || event_type AS notes, event_id % 2 = 0 AS manual, ts AS created_at FROM {events}""",
    "m_queue": """SELECT o_orderkey AS id, 'Title ' || o_orderpriority AS title, 'Writer ' || CAST(o_custkey % 50 AS STRING) AS author, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'imported' ELSE 'inProgress' END AS status,
        CASE WHEN o_orderstatus = 'F' THEN 'b' || CAST(o_custkey AS STRING) END AS imported_book_id, o_orderdate AS created_at FROM {orders}""",
    "m_citations": f"""SELECT {_CITATION} AS id, 'b' || CAST(min(l_suppkey) AS STRING) AS source_book_id, CAST(min(l_quantity) AS INT) AS source_page, CAST(l_linenumber AS STRING) AS footnote,
        CASE WHEN min(l_returnflag) = 'R' THEN NULL WHEN min(l_partkey) % 5 = 0 THEN 'alt' || CAST(min(l_partkey) % 97 AS STRING) ELSE 'b' || CAST(min(l_partkey) AS STRING) END AS reference_book_id,
        CASE WHEN l_linenumber = 3 THEN '' ELSE 'Writer ' || CAST(min(l_suppkey) % 9 AS STRING) END AS author, 'Work ' || CAST(min(l_partkey) % 300 AS STRING) AS title,
        'p. ' || CAST(CAST(min(l_quantity) AS INT) AS STRING) AS location, 'Writer, Work_' || CAST(min(l_partkey) % 300 AS STRING) || ' 100%' AS raw FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber""",
    "m_groups": f"""SELECT ({_CITATION}) * 64 + CAST(l_quantity AS INT) AS id, {_CITATION} AS citation_id, 'g' || CAST(min(l_suppkey) % 2 AS STRING) AS raw,
        CASE WHEN {_ON_PAGE} THEN 'page' ELSE 'book' END AS part1_type, CASE WHEN {_ON_PAGE} THEN CAST(l_quantity AS INT) % 5 ELSE CAST(l_linenumber AS INT) END AS part1_value,
        CASE WHEN {_ON_PAGE} THEN NULL ELSE 'chapter' END AS part2_type, CASE WHEN {_ON_PAGE} THEN NULL ELSE CAST(l_quantity AS INT) % 10 END AS part2_value,
        CASE WHEN {_ON_PAGE} OR l_linenumber > 4 THEN NULL ELSE 'verse' END AS part3_type, CASE WHEN {_ON_PAGE} OR l_linenumber > 4 THEN NULL ELSE CAST(min(l_suppkey) % 5 AS INT) END AS part3_value
        FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber, l_quantity""",
    "m_pages": f"""SELECT 'b' || CAST(p_partkey AS STRING) AS book_id, CAST(n AS INT) AS page_number, CASE WHEN (p_partkey + n) % 6 = 0 THEN 'x' ELSE CAST(n AS STRING) END AS printed
        FROM {{part}} CROSS JOIN {_NUMBERS}""",
    "m_places": f"""SELECT p_partkey * 8 + n AS id, 'b' || CAST(p_partkey AS STRING) AS book_id, CAST(n AS INT) AS page_number, 'book' AS part1_type, CAST((p_partkey + n - n % 2) % 7 + 1 AS INT) AS part1_value,
        CASE WHEN n % 2 = 0 THEN 'chapter' END AS part2_type, CASE WHEN n % 2 = 0 THEN CAST(p_size % 10 AS INT) END AS part2_value,
        CASE WHEN n = 4 THEN 'verse' END AS part3_type, CASE WHEN n = 4 THEN CAST(p_partkey % 5 AS INT) END AS part3_value FROM {{part}} CROSS JOIN {_NUMBERS} WHERE p_partkey % 3 <> 0""",
    "m_blocks": f"""SELECT p_partkey * 8 + n AS id, 'b' || CAST(p_partkey AS STRING) AS book_id, CAST(p_partkey % 2 + 1 AS INT) AS page_number, CAST(n AS INT) AS position,
        CASE n WHEN 1 THEN 'PageHeader' WHEN 2 THEN 'Text' WHEN 3 THEN 'Footnote' ELSE 'Text' END AS label,
        '<p>' || p_name || ' &amp; <b>' || p_brand || '</b><br/>' || CAST(n AS STRING) || '  of   &quot;' || p_type || '&quot;</p>' AS html FROM {{part}} CROSS JOIN {_NUMBERS}""",
    "m_insights": """SELECT min(event_id) AS id, 'Insight ' || event_type || ' ' || CAST(user_id AS STRING) AS insight, CASE WHEN min(event_id) % 6 = 0 THEN NULL ELSE CAST(min(event_id) % 6 AS INT) END AS score,
        CASE user_id % 25 WHEN 0 THEN 'economy' WHEN 1 THEN 'small' WHEN 2 THEN 'standard' ELSE 'kw' || CAST(user_id AS STRING) END AS keyword1, 'kx' || CAST(min(event_id) % 200 AS STRING) AS keyword2, event_type AS kind
        FROM {events} GROUP BY event_type, user_id""",
}


#: The least of some letters by sorting is as well told by two truths, which are counted without a sort.
_LEAST, _TOLD = "min(l_returnflag) = 'R'", "bool_or(l_returnflag = 'R') AND bool_and(l_returnflag >= 'R')"
#: What the rows of a citation are grouped by. They are dealt by the citation's id from the start, so that citations and their places lie together where they meet.
_ROWS, _DEALT_ROWS = "GROUP BY l_orderkey, l_linenumber", "GROUP BY _citation, l_orderkey, l_linenumber"
#: Rows of ``part`` that a task takes, about: each becomes several rows and texts, and a file of many is one split or two.
DEALT = 25_000


def needs(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", MODEL[name])


class Library:
    """The model tables over a folder of Parquet tables, each made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in MODEL:
                sql, frames = MODEL[name].replace(_LEAST, _TOLD), {n: self.table(n) for n in needs(name)}
                if _ROWS in sql:
                    sql = sql.replace(_CITATION, "_citation").replace(_ROWS, _DEALT_ROWS)
                    frames["lineitem"] = frames["lineitem"].withColumn("_citation", F.expr(_CITATION)).repartition("_citation")
                self._made[name] = self.spark.sql(sql, **frames)
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                if name == "part":
                    self._made[name] = self._dealt(self._made[name])
        return self._made[name]

    def _dealt(self, part: DataFrame) -> DataFrame:
        """The rows over all tasks, more tasks for more rows; they are counted from the files' footers."""
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-part.count() // DEALT))
        return part.repartition(tasks, "p_partkey")

    def __getattr__(self, name: str) -> DataFrame:
        if f"m_{name}" in MODEL:
            return self.table(f"m_{name}")
        raise AttributeError(name)

    @cached_property
    def groups(self) -> DataFrame:
        """citation_groups with places as arrays."""
        return parts_of(self.table("m_groups"), 3)

    @cached_property
    def places(self) -> DataFrame:
        """book_pages_to_citations with places as arrays."""
        return parts_of(self.table("m_places"), 3)


def oracle(sql: str) -> str:
    """The SQL with the model tables that it names as CTEs, for DuckDB."""
    found: list[str] = []

    def add(name: str) -> None:
        for n in needs(name):
            if n in MODEL:
                add(n)
        if name not in found:
            found.append(name)

    for name in re.findall(r"\bm_\w+", sql):
        if name in MODEL:
            add(name)
    ctes = ",\n".join(f"{n} AS ({MODEL[n].format(**{x: x for x in needs(n)})})" for n in found)
    if not ctes:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    return f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"
