"""Flood guides: documents as guides, the names of parts as stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators import guides
from tidewatch.plans.registry import query, table

#: Stations of the distinct names of parts, and three texts of each document: its own, with a name, with another one.
GUIDES = """, names AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS seq, count(*) OVER () AS k FROM (SELECT DISTINCT p_name FROM part)),
st AS (SELECT seq, k, CASE WHEN seq % 5 = 0 THEN p_name ELSE split_part(p_name, ' ', 2) || ' at ' || split_part(p_name, ' ', 1) || ' weir' END AS norm, CASE WHEN seq % 5 = 0 THEN p_name ELSE split_part(p_name, ' ', 2) END AS river,
  CASE WHEN seq % 5 = 0 THEN [] ELSE list_filter([split_part(p_name, ' ', 1)], lambda x: length(x) >= 3) END AS tokens, seq AS minor, seq + 1 AS moderate, seq + 2 AS major FROM names),
d AS (SELECT doc_id AS unit, text, a.p_name AS one, b.p_name AS two, a.seq AS base FROM documents JOIN names a ON a.seq = doc_id % a.k JOIN names b ON b.seq = (doc_id * 7 + 3) % b.k),
cx AS (SELECT unit, 0 AS step, 1 AS page, text FROM d UNION ALL SELECT unit, 1, 1, text || ' ' || one FROM d UNION ALL SELECT unit, 2, 0, text || ' ' || one || ' ' || two FROM d),
nx AS (SELECT unit, step, page, trim(regexp_replace(regexp_replace(lower(text), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS t FROM cx),
hit AS (SELECT unit, step, page, st.* FROM nx JOIN st ON length(river) >= 4 AND contains(t, river) AND CASE WHEN len(tokens) > 0 THEN contains(t, tokens[1]) ELSE contains(t, norm) END),
scored AS (SELECT h.unit, h.step, h.seq, 4 * (CAST(abs(base + 0.1 - minor) <= 0.15 AS INT) + CASE WHEN h.unit % 2 = 0 THEN CAST(abs(base + 1.4 - moderate) <= 0.15 AS INT) ELSE 0 END + CAST(abs(base + 2.05 - major) <= 0.15 AS INT))
  + CASE WHEN len(tokens) > 0 AND contains(two, tokens[1]) THEN 5 ELSE 0 END + page AS score FROM hit h JOIN d ON d.unit = h.unit),
best AS (SELECT unit, seq, step, score FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY step, score DESC, seq) AS n FROM scored) WHERE n = 1)
"""


def _known(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(seq, p_name, k) of the distinct names of parts, and the stations made of them."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    # names are few: they are numbered in one window
    names = names.select("p_name", (F.row_number().over(Window.orderBy("p_name")) - 1).alias("seq")).crossJoin(F.broadcast(names.agg(F.count("*").alias("k"))))
    two = F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" at "), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" Weir"))
    rows = names.select("seq", F.when(F.col("seq") % 5 == 0, F.initcap("p_name")).otherwise(two).alias("name"), *[(F.col("seq") + n).cast("double").alias(c) for n, c in enumerate(guides.CLASSES)])
    return names, guides.stations(rows)


def _documents(spark: SparkSession, sf_dir: str, names: DataFrame) -> DataFrame:
    k = names.select("k").distinct()
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), "text").crossJoin(F.broadcast(k))
    one, two = (names.select(F.col("seq").alias(f"_{c}"), F.col("p_name").alias(c)) for c in ("one", "two"))
    docs = docs.withColumns({"_one": F.col("unit") % F.col("k"), "_two": (F.col("unit") * 7 + 3) % F.col("k")})
    return docs.join(one, "_one").join(two, "_two").withColumnRenamed("_one", "base")


def _best(docs: DataFrame, known: DataFrame) -> DataFrame:
    units = docs.select("unit", F.concat("two", F.lit(" Local Flood Guide LFG.pdf")).alias("file"), (F.col("base") + 0.1).alias("minor"), F.when(F.col("unit") % 2 == 0, F.col("base") + 1.4).alias("moderate"), (F.col("base") + 2.05).alias("major"))
    texts = [F.col("text"), F.concat_ws(" ", "text", "one"), F.concat_ws(" ", "text", "one", "two")]
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(k < 2).alias("page"), t.alias("t")) for k, t in enumerate(texts)]))
    contexts = docs.select("unit", steps.alias("x")).select("unit", "x.step", "x.page", F.col("x.t").alias("text"))
    return guides.best_station(units, contexts, known)


@query(GUIDES + "SELECT unit, seq, step, score FROM best")
def guide_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The station that each guide speaks of."""
    names, known = _known(spark, sf_dir)
    return _best(_documents(spark, sf_dir, names), known)


PAGE_SQL = """, ln AS (SELECT unit, i, list_extract(string_split(text, chr(10)), CAST(i AS INT)) AS line FROM d, range(1, 100000) AS t(i) WHERE i <= len(string_split(text, chr(10)))),
rw AS (SELECT unit, i, 0.5 + (i % 9) * 0.25 AS height_m, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS impact FROM ln WHERE trim(regexp_replace(line, '\\s+', ' ', 'g')) <> ''),
cl AS (SELECT * FROM rw WHERE length(impact) >= 4)
"""


@query(GUIDES + PAGE_SQL + "SELECT seq, height_m, arg_min(impact, (unit, i)) AS impact FROM cl JOIN best USING (unit) GROUP BY seq, height_m, lower(left(impact, 40))")
def guide_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What guides say of heights, by station: each line of a document after a line with a height."""
    names, known = _known(spark, sf_dir)
    docs = _documents(spark, sf_dir, names)
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.format_string("%.2f m\n", 0.5 + ((i + 1) % 9) * 0.25), x))
    rows = guides.cleaned(guides.page_rows(docs.select("unit", F.array_join(lines, "\n").alias("text"))))
    return guides.impacts(rows, _best(docs, known))
