"""Ready-made join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from motes.functions import keys
from motes.operators import matching
from motes.plans.registry import query
from motes.plans.standins import PARTICLES, particles, table, with_


def P(body: str) -> str:
    return with_(PARTICLES) + body


def _optics(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("og"), F.col("n_name").alias("og_name"), F.col("n_regionkey").alias("voltage"))


def _imaged(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_row"), F.col("c_nationkey").alias("og"), "c_acctbal")


@query("j1_with_optics", "SELECT c_custkey AS _row, c_acctbal, n_name AS og_name, n_regionkey AS voltage FROM customer JOIN nation ON c_nationkey = n_nationkey")
def with_optics(spark, sf_dir):
    return matching.with_optics(_imaged(spark, sf_dir), _optics(spark, sf_dir), "og")


@query("j1_lineitem_optics", "SELECT n_name AS og_name, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def lineitem_optics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_quantity")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("og"))
    placed = matching.with_optics(li, sup, "s_suppkey")
    return matching.with_optics(placed, _optics(spark, sf_dir), "og").groupBy("og_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("qty")
    )


@query("j2_checked_optics", "SELECT c_custkey AS _row, c_nationkey AS og, c_acctbal, n_name AS og_name, n_regionkey AS voltage FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def checked_optics(spark, sf_dir):
    return matching.with_checked_optics(_imaged(spark, sf_dir), _optics(spark, sf_dir), "og")


@query(
    "j3_recover_optics",
    """WITH pt AS (SELECT c_custkey AS _row, c_nationkey AS og, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS voltage, c_mktsegment AS cs FROM customer)
    SELECT n_nationkey AS og, n_name AS og_name,
      coalesce(CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey AS DOUBLE) END, (SELECT arg_min(voltage, _row) FROM pt WHERE og = n_nationkey AND voltage IS NOT NULL)) AS voltage,
      (SELECT arg_min(cs, _row) FROM pt WHERE og = n_nationkey) AS cs FROM nation""",
)
def recover_optics(spark, sf_dir):
    pt = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("_row"), F.col("c_nationkey").alias("og"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("voltage"), F.col("c_mktsegment").alias("cs")
    )
    opt = _optics(spark, sf_dir).withColumn("voltage", F.when(F.col("og") % 2 == 0, F.col("voltage").cast("double")))
    return matching.recover_optics(opt, pt, "og", ["voltage", "cs"]).select("og", "og_name", "voltage", "cs")


OTHER = "other AS (SELECT image_no, stack, _row, score + 1 AS score, rot + 1 AS rot FROM p WHERE subset = 2 AND class < 4 AND tilt < 90)"


def _other(spark, sf_dir):
    p = particles(spark, sf_dir).filter("subset = 2 and class < 4 and tilt < 90")
    return p.select("image_no", "stack", "_row", (F.col("score") + 1).alias("score"), (F.col("rot") + 1).alias("rot"))


@query("j4_missing_rows", with_(PARTICLES, OTHER) + "SELECT _row, image_no, stack FROM p WHERE NOT EXISTS (SELECT 1 FROM other o WHERE o.image_no = p.image_no AND o.stack = p.stack)")
def missing_rows(spark, sf_dir):
    return matching.missing_from(particles(spark, sf_dir).select("_row", "image_no", "stack"), _other(spark, sf_dir), ["image_no", "stack"])


@query("j5_common_rows", with_(PARTICLES, OTHER) + "SELECT _row, image_no, stack FROM p WHERE EXISTS (SELECT 1 FROM other o WHERE o.image_no = p.image_no AND o.stack = p.stack)")
def common_rows(spark, sf_dir):
    return matching.common_with(particles(spark, sf_dir).select("_row", "image_no", "stack"), _other(spark, sf_dir), ["image_no", "stack"])


MAPPING = """mp AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '@joined' AS image, lpad(CAST(c_custkey % 100 + 1 AS VARCHAR), 6, '0') || '@' || c_mktsegment AS source FROM customer WHERE c_custkey % 10 <> 3),
pr AS (SELECT o_orderkey AS _row, lpad(CAST(o_custkey AS VARCHAR), 6, '0') || '@joined' AS image FROM orders)"""


def _mapping(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 3")
    mp = c.select(keys.image_key(F.col("c_custkey"), F.lit("joined")).alias("image"), keys.image_key(F.col("c_custkey") % 100 + 1, F.col("c_mktsegment")).alias("source"))
    pr = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_row"), keys.image_key(F.col("o_custkey"), F.lit("joined")).alias("image"))
    return pr, mp


@query("j6_back_map", with_(MAPPING) + "SELECT _row, coalesce(source, pr.image) AS image, pr.image AS was FROM pr LEFT JOIN mp ON pr.image = mp.image")
def back_map(spark, sf_dir):
    pr, mp = _mapping(spark, sf_dir)
    return matching.back_map(pr, mp, "image", "source", strict=False, audit="was").select("_row", "image", "was")


@query(
    "j6_back_map_report",
    with_(MAPPING)
    + """SELECT count(*) AS n_processed, count(source) AS n_mapped, count(*) - count(source) AS n_missing,
    (SELECT count(*) FROM mp) AS n_mapping_rows, CAST(0 AS BIGINT) AS n_repeated, CAST(0 AS BIGINT) AS n_conflicting FROM pr LEFT JOIN mp ON pr.image = mp.image""",
)
def back_map_report(spark, sf_dir):
    return matching.back_map_report(*_mapping(spark, sf_dir), "image", "source")


@query(
    "j7_update_columns",
    with_(PARTICLES, OTHER)
    + """, t AS (SELECT image_no, stack, arg_min(rot, _row) AS rot, arg_min(score, _row) AS score FROM other GROUP BY ALL)
    SELECT p._row, coalesce(t.rot, p.rot) AS rot, coalesce(t.score, p.score) AS score FROM p LEFT JOIN t USING (image_no, stack)""",
)
def update_columns(spark, sf_dir):
    p = particles(spark, sf_dir).select("_row", "image_no", "stack", "rot", "score")
    return matching.update_columns(p, _other(spark, sf_dir), ["image_no", "stack"], ["rot", "score"]).select("_row", "rot", "score")


@query(
    "j8_override_rows",
    with_(PARTICLES, OTHER)
    + """, a AS (SELECT *, row_number() OVER (PARTITION BY image_no, stack ORDER BY _row) AS n FROM p),
    b AS (SELECT *, row_number() OVER (PARTITION BY image_no, stack ORDER BY _row) AS n FROM other)
    SELECT a._row, coalesce(b.rot, a.rot) AS rot, coalesce(b.score, a.score) AS score, b._row IS NOT NULL AS updated FROM a LEFT JOIN b USING (image_no, stack, n)""",
)
def override_rows(spark, sf_dir):
    p = particles(spark, sf_dir).select("_row", "image_no", "stack", "rot", "score")
    return matching.override_rows(p, _other(spark, sf_dir), ["image_no", "stack"]).drop("image_no", "stack")


@query(
    "j9_match_positions",
    with_(PARTICLES)
    + """, a AS (SELECT *, row_number() OVER (PARTITION BY mic, y, class ORDER BY _row) AS n FROM p WHERE subset = 1),
    b AS (SELECT *, row_number() OVER (PARTITION BY mic, y, class ORDER BY _row) AS n FROM p WHERE subset = 2)
    SELECT a._row, 'k' || CAST(b._row AS VARCHAR) AS image FROM a JOIN b USING (mic, y, class, n)""",
)
def match_positions(spark, sf_dir):
    p = particles(spark, sf_dir).select("_row", "mic", "y", "class", "subset", F.concat(F.lit("k"), F.col("_row").cast("string")).alias("image"))
    a, b = p.filter("subset = 1").drop("subset"), p.filter("subset = 2").drop("subset")
    return matching.match_positions(a, b, x="y", y="class").select("_row", "image")


DOCS = "docs AS (SELECT doc_id AS _row, source || '/' || lang || '_' || CAST(doc_id % 400 AS VARCHAR) || '-part.star' AS mic FROM documents)"
MICS = "mics AS (SELECT DISTINCT doc_id % 300 AS _row, 'raw/' || lang || '-' || CAST(doc_id % 300 AS VARCHAR) || '.mrc' AS mic FROM documents)"


def _named(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    docs = d.select(F.col("doc_id").alias("_row"), F.concat("source", F.lit("/"), "lang", F.lit("_"), (F.col("doc_id") % 400).cast("string"), F.lit("-part.star")).alias("mic"))
    mics = d.select((F.col("doc_id") % 300).alias("_row"), F.concat(F.lit("raw/"), "lang", F.lit("-"), (F.col("doc_id") % 300).cast("string"), F.lit(".mrc")).alias("mic")).distinct()
    return docs, mics


SIMPLE = "translate(regexp_replace(regexp_replace({}, '^.*/', ''), '\\.[^.]*$', ''), '._-', '')"


@query(
    "j10_assign_micrographs",
    with_(DOCS, MICS)
    + f"""SELECT d._row, (SELECT min(m._row) FROM mics m WHERE contains({SIMPLE.format('d.mic')}, {SIMPLE.format('m.mic')})) AS mic_row FROM docs d""",
)
def assign_micrographs(spark, sf_dir):
    docs, mics = _named(spark, sf_dir)
    return matching.assign_micrographs(docs, mics).select("_row", "mic_row")


@query(
    "j10_transfer_fields",
    with_(DOCS, MICS)
    + f""", a AS (SELECT d._row, CAST(d._row AS DOUBLE) AS x, (SELECT min(m._row) FROM mics m WHERE contains({SIMPLE.format('d.mic')}, {SIMPLE.format('m.mic')})) AS mic_row FROM docs d)
    SELECT a._row, x / 4 AS x, mic_row * 10 AS defocus FROM a""",
)
def transfer_fields(spark, sf_dir):
    docs, mics = _named(spark, sf_dir)
    placed = matching.assign_micrographs(docs.withColumn("x", F.col("_row").cast("double")), mics)
    side = mics.groupBy("_row").agg(F.max(F.col("_row") * 10).alias("defocus"))
    return matching.transfer_fields(placed, side, ["defocus"], 4.0, ["x"]).select("_row", "x", "defocus")


@query(
    "j11_import_by_name",
    with_(DOCS)
    + f""", m AS (SELECT {SIMPLE.format("lang || '-' || CAST(doc_id % 400 AS VARCHAR) || '.part.mrc'")} AS s, arg_min(n_chars, doc_id) AS defocus FROM documents GROUP BY 1)
    SELECT _row, defocus FROM docs LEFT JOIN m ON {SIMPLE.format('docs.mic')} = s""",
)
def import_by_name(spark, sf_dir):
    docs, _ = _named(spark, sf_dir)
    m = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("_row"), F.concat("lang", F.lit("-"), (F.col("doc_id") % 400).cast("string"), F.lit(".part.mrc")).alias("mic"), F.col("n_chars").alias("defocus")
    )
    return matching.import_by_name(docs, m, ["defocus"]).select("_row", "defocus")


@query(
    "j12_match_rounded",
    with_(PARTICLES)
    + """, t AS (SELECT _row, score, round(tilt + 0.2) AS a, round(y / 10 + 0.1) AS b FROM p WHERE subset = 1),
    i AS (SELECT _row, round(tilt - 0.3) AS a, round(y / 10 + 0.13) AS b FROM p WHERE subset = 2),
    tt AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY _row) AS n FROM t),
    ii AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY _row) AS n FROM i)
    SELECT tt._row, score, 'k' || CAST(ii._row AS VARCHAR) AS matched_image FROM tt JOIN ii USING (a, b, n)""",
)
def match_rounded(spark, sf_dir):
    p = particles(spark, sf_dir)
    t = p.filter("subset = 1").select("_row", "score", (F.col("tilt") + 0.2).alias("a"), (F.col("y") / 10 + 0.1).alias("b"))
    i = p.filter("subset = 2").select("_row", (F.col("tilt") - 0.3).alias("a"), (F.col("y") / 10 + 0.13).alias("b"), F.concat(F.lit("k"), F.col("_row").cast("string")).alias("image"))
    return matching.match_rounded(t, i, ["a", "b"]).select("_row", "score", "matched_image")


ARRAY = """arr AS (SELECT c_custkey AS _row, CAST(c_custkey % 40 AS INTEGER) AS idx, 'J40/imported/01598012330511' || CAST(c_custkey % 5 AS VARCHAR) || '_st' || CAST(c_custkey % 5 + 1 AS VARCHAR) || '.mrcs' AS path, c_acctbal AS score FROM customer WHERE c_custkey % 2 = 0)"""


@query(
    "j13_update_from_array",
    with_(PARTICLES, ARRAY)
    + """, k AS (SELECT idx, regexp_replace(regexp_replace(path, '^.*/', ''), '^[0-9]{8,}_', '') AS base, arg_min(score, _row) AS s FROM arr GROUP BY 1, 2)
    SELECT p._row, coalesce(s, p.score) AS score FROM p LEFT JOIN k ON p.image_no - 1 = k.idx AND 'st' || regexp_replace(p.stack, '^.*/', '') = k.base""",
)
def update_from_array(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0")
    path = F.concat(F.lit("J40/imported/01598012330511"), (F.col("c_custkey") % 5).cast("string"), F.lit("_st"), (F.col("c_custkey") % 5 + 1).cast("string"), F.lit(".mrcs"))
    arr = c.select(F.col("c_custkey").alias("_row"), (F.col("c_custkey") % 40).cast("int").alias("idx"), keys.stack_base(path).alias("base"), F.col("c_acctbal").alias("score"))
    p = particles(spark, sf_dir).select("_row", (F.col("image_no") - 1).alias("idx"), F.concat(F.lit("st"), keys.base_name(F.col("stack"))).alias("base"), "score")
    return matching.update_from_array(p, arr, ["idx", "base"], ["score"]).select("_row", "score")


@query(
    "j14_expand_ranges",
    """WITH e AS (SELECT p_partkey, p_brand, p_size AS vs, p_size + p_partkey % 7 AS ve, p_retailprice * 10 AS defocus FROM part),
    r AS (SELECT *, unnest(range(CAST(vs AS BIGINT), CAST(ve AS BIGINT) + 1)) AS tilt FROM e)
    SELECT p_brand, CAST(tilt AS BIGINT) AS tilt, arg_max(defocus, p_partkey) AS defocus FROM r GROUP BY 1, 2""",
)
def expand_ranges(spark, sf_dir):
    e = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", F.col("p_size").cast("bigint").alias("vs"), (F.col("p_size") + F.col("p_partkey") % 7).alias("ve"), (F.col("p_retailprice") * 10).alias("defocus")
    )
    return matching.expand_ranges(e, "vs", "ve", ["p_brand"], "p_partkey", ["defocus"], "tilt")


@query(
    "j14_last_covering",
    """WITH e AS (SELECT p_partkey, p_brand, CAST(p_retailprice * 10 AS BIGINT) AS vs, CAST(p_retailprice * 10 + (p_partkey % 7) * 100000 AS BIGINT) AS ve, p_size AS d FROM part),
    q AS (SELECT s_suppkey, 'Brand#' || (s_suppkey % 5 + 1) || (s_nationkey % 5 + 1) AS p_brand, CAST(s_acctbal * 20 AS BIGINT) AS tilt FROM supplier)
    SELECT s_suppkey, q.p_brand, tilt, arg_max(d, p_partkey) AS d FROM q LEFT JOIN e ON e.p_brand = q.p_brand AND tilt BETWEEN vs AND ve GROUP BY 1, 2, 3""",
)
def last_covering(spark, sf_dir):
    """Ranges of up to 600,000 numbers; no row per number."""
    e = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.round(F.col("p_retailprice") * 10).cast("bigint").alias("vs"), F.round(F.col("p_retailprice") * 10 + (F.col("p_partkey") % 7) * 100000).cast("bigint").alias("ve"), F.col("p_size").alias("d"))
    brand = F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 5 + 1).cast("string"), (F.col("s_nationkey") % 5 + 1).cast("string"))
    q = table(spark, sf_dir, "supplier").select("s_suppkey", brand.alias("p_brand"), F.round(F.col("s_acctbal") * 20).cast("bigint").alias("tilt"))
    return matching.last_covering(q, "tilt", e, "vs", "ve", ["p_brand"], "p_partkey", ["d"])


@query(
    "j15_reconcile",
    """WITH reg AS (SELECT DISTINCT o_orderpriority AS tomo, o_custkey AS particle FROM orders WHERE o_orderkey % 3 <> 0),
    disk AS (SELECT DISTINCT o_orderpriority AS tomo, o_custkey AS particle FROM orders WHERE o_orderkey % 3 <> 1),
    rec AS (SELECT DISTINCT o_orderpriority AS tomo, o_custkey AS particle FROM orders WHERE o_orderkey % 5 = 0),
    ali AS (SELECT DISTINCT o_orderpriority AS tomo, o_custkey AS particle FROM orders WHERE o_orderkey % 7 = 0),
    raw AS (SELECT DISTINCT o_orderpriority AS tomo, o_custkey AS particle FROM orders WHERE o_orderkey % 11 = 0)
    SELECT *, 'registered_but_no_star' AS issue FROM (FROM reg EXCEPT FROM disk) UNION ALL
    SELECT *, 'star_not_registered' FROM (FROM disk EXCEPT FROM reg) UNION ALL
    SELECT *, 'orphan_rec_crop' FROM (FROM rec EXCEPT FROM disk) UNION ALL
    SELECT *, 'orphan_ali_crop' FROM (FROM ali EXCEPT FROM disk) UNION ALL
    SELECT *, 'orphan_raw_crop' FROM (FROM raw EXCEPT FROM disk)""",
)
def reconcile(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("tomo"), F.col("o_custkey").alias("particle"))
    k = F.col("o_orderkey")
    return matching.reconcile(o.filter(k % 3 != 0), o.filter(k % 3 != 1), {"rec": o.filter(k % 5 == 0), "ali": o.filter(k % 7 == 0), "raw": o.filter(k % 11 == 0)})


@query(
    "j18_best_refinement",
    with_(PARTICLES)
    + """, r AS (SELECT _row, cust AS image, score, rot, tilt, 0 AS src FROM p WHERE class <= 2),
    a AS (SELECT cust AS image, arg_min(score, _row) AS score, arg_min(rot, _row) AS rot, arg_min(tilt, _row) AS tilt, 1 AS src FROM p WHERE class = 3 GROUP BY 1),
    b AS (SELECT cust AS image, arg_min(score, _row) AS score, arg_min(rot, _row) AS rot, arg_min(tilt, _row) AS tilt, 2 AS src FROM p WHERE class > 3 GROUP BY 1),
    o AS (FROM a UNION ALL FROM b),
    u AS (FROM r UNION ALL SELECT r._row, o.* FROM r JOIN o USING (image))
    SELECT _row, image, rot, tilt, CAST(src AS INTEGER) AS source FROM u QUALIFY row_number() OVER (PARTITION BY _row ORDER BY score DESC, src DESC) = 1""",
)
def best_refinement(spark, sf_dir):
    p = particles(spark, sf_dir).select("_row", F.col("cust").alias("image"), "score", "rot", "tilt", "class")
    reference = p.filter("class <= 2").drop("class")
    best = matching.best_refinement(reference, [p.filter("class = 3"), p.filter("class > 3")], ["image"], "score", ["rot", "tilt"])
    return best.drop("score")


@query(
    "j21_gather_slices",
    """WITH w AS (SELECT o_orderkey AS _row, o_custkey % (SELECT count(*) FROM embeddings) AS v FROM orders)
    SELECT _row, lpad(CAST(row_number() OVER (ORDER BY _row) AS VARCHAR), 6, '0') || '@out.mrcs' AS image,
      lpad(CAST(vec_id // 10 + 1 AS VARCHAR), 6, '0') || '@s' || CAST(vec_id % 10 AS VARCHAR) AS source_image, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding]), 5) AS total
    FROM w JOIN embeddings ON v = vec_id""",
)
def gather_slices(spark, sf_dir):
    v = F.col("o_custkey") % table(spark, sf_dir, "embeddings").count()
    want = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("_row"), F.concat(F.lit("s"), (v % 10).cast("string")).alias("stack"), (F.floor(v / 10) + 1).cast("int").alias("image_no")
    )
    have = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("s"), (F.col("vec_id") % 10).cast("string")).alias("stack"), F.floor(F.col("vec_id") / 10).cast("int").alias("slice"),
        F.lit(8).alias("ny"), F.lit(8).alias("nx"), F.transform("embedding", lambda x: x.cast("double")).alias("px"),
    )
    out = matching.gather_slices(want, have, "out.mrcs")
    return out.select("_row", "image", "source_image", F.round(F.aggregate("px", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(
    "j22_resolve_paths",
    """WITH u AS (SELECT page_id, regexp_replace(url, '^https?:/', '.') AS stack FROM pages),
    f AS (SELECT CASE page_id % 3 WHEN 0 THEN '/data/' ELSE '/star/' END || substr(stack, 3) AS path FROM u WHERE page_id % 3 < 2 UNION ALL SELECT substr(stack, 3) FROM u WHERE page_id % 4 = 0),
    c AS (SELECT page_id, stack, 0 AS pr, '/data/' || substr(stack, 3) AS cand FROM u UNION ALL SELECT page_id, stack, 1, substr(stack, 3) FROM u UNION ALL SELECT page_id, stack, 2, '/star/' || substr(stack, 3) FROM u)
    SELECT page_id, cand AS resolved FROM c QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY cand NOT IN (SELECT path FROM f), pr) = 1""",
)
def resolve_paths(spark, sf_dir):
    u = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?:/", ".").alias("stack"))
    rel = F.substring(F.col("stack"), F.lit(3), F.length("stack"))
    third = F.col("page_id") % 3
    f = u.filter(third < 2).select(F.concat(F.when(third == 0, F.lit("/data/")).otherwise(F.lit("/star/")), rel).alias("path"))
    f = f.union(u.filter(F.col("page_id") % 4 == 0).select(rel))
    return matching.resolve_paths(u, f, "/data", "/star").select("page_id", "resolved")
