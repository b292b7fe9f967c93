"""Registered queries of the near-duplicate engine and the SQL they are held against."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from twinsift import config
from twinsift.functions import fingerprints, scalars
from twinsift.operators import grouping, manifest, pairs, review, scoring
from twinsift.operators.components import connected_components
from twinsift.plans import pipeline, views
from twinsift.sources import cache, files

QUERIES, ORACLES = {}, {}
TEXT_T, VECTOR_T = 10, 20
LINE_WEIGHTS = {"l_quantity": 0.35, "l_extendedprice": 0.20, "l_discount": -0.10, "l_tax": -0.10}
LABEL_WEIGHTS = {"n_chars": 0.5, "quality": 0.3, "toxic": -0.2}
ROOT = "/archive"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- paths: pages as an archive of files -------------------------------------------------

P = """p AS (SELECT min(page_id) AS page_id, path, max(size)::BIGINT AS size, split_part(path, '/', 3) AS host FROM (
    SELECT page_id, '/archive' || regexp_replace(regexp_replace(regexp_replace(url, '^https?://', '/'), '[?#].*$', ''), '/+$', '') AS path, length(html) AS size FROM pages) GROUP BY path)"""
M = P + """, m AS (SELECT *, dense_rank() OVER (ORDER BY host) - 1 AS group_id,
    row_number() OVER (PARTITION BY host ORDER BY string_split(path, '/'), page_id) - 1 AS member_idx, count(*) OVER (PARTITION BY host) AS n FROM p),
    k AS (SELECT *, CASE WHEN group_id % 2 = 0 THEN 0 ELSE n - 1 END AS pick FROM m)"""


def paths(spark, sf_dir):
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://", "/"), "[?#].*$", ""), "/+$", "")
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit(ROOT), url).alias("path"), F.length("html").cast("long").alias("size"))
    return rows.groupBy("path").agg(F.min("page_id").alias("page_id"), F.max("size").alias("size")).withColumn("host", F.element_at(F.split("path", "/"), 3))


def page_members(spark, sf_dir):
    """Groups are hosts; the pick is the first member, or the last in odd groups."""
    p = paths(spark, sf_dir)
    hosts = grouping.number(p.groupBy("host").agg(F.count("*").alias("n")), "host", "group_id")
    m = grouping.ranked(p.join(hosts, "host").withColumn("k", F.struct(files.path_key("path"), "page_id")), "host", "k", "member_idx").drop("k")
    return m.withColumn("pick", F.when(F.col("group_id") % 2 == 0, 0).otherwise(F.col("n") - 1))


def picks(m):
    return m.groupBy("group_id").agg(F.max("pick").alias("pick"))


@query(f"WITH {P} SELECT path FROM p WHERE regexp_matches(path, '^/archive/[^/]+/en/[^/]+\\.[hH][tT][mM][lL]$')")
def scan_flat(spark, sf_dir):
    """A flat scan of every host's /en folder; the folder is taken from the row."""
    p = paths(spark, sf_dir).select("path", F.concat(F.lit(f"{ROOT}/"), "host", F.lit("/en")).alias("folder"))
    return files.select_files(p, F.col("folder"), suffixes=(".html",)).select("path")


@query(f"WITH {P} SELECT path FROM p WHERE regexp_matches(lower(path), '[^/]\\.html$') AND NOT starts_with(path, '/archive/blog.therti.example.org/')")
def scan_recursive(spark, sf_dir):
    return files.select_files(paths(spark, sf_dir), ROOT, True, f"{ROOT}/blog.therti.example.org", (".html",)).select("path")


@query(f"WITH {P} SELECT path, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS suffix, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) IN ('.html', '.htm') AS is_known FROM p")
def ext_filter(spark, sf_dir):
    return paths(spark, sf_dir).select("path", scalars.suffix("path").alias("suffix"), files.has_suffix("path", (".html", ".htm")).alias("is_known"))


@query(f"WITH {P} SELECT path FROM p WHERE split_part(path, '/', 4) <> 'en' OR NOT starts_with(host, 'www')")
def exclude_prefix(spark, sf_dir):
    p = paths(spark, sf_dir)
    # each www host's /en folder, taken from the row as in scan_flat: any number of them
    folder = F.concat(F.lit(f"{ROOT}/"), F.col("host"), F.lit("/en"))
    outside = (F.col("path") != folder) & ~F.col("path").startswith(F.concat(folder, F.lit("/")))
    return p.filter(~F.col("host").startswith("www") | outside).select("path")


@query(f"WITH {P} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS place FROM p")
def path_order(spark, sf_dir):
    return grouping.number(paths(spark, sf_dir).select("path", files.path_key("path").alias("k")), "k", "place").select("path", "place")


@query(f"WITH {P} SELECT path, CASE WHEN starts_with(path, '/archive/') THEN substr(path, 10) ELSE path END AS shown, regexp_extract(path, '[^/]*$') AS name FROM p")
def display_path(spark, sf_dir):
    return paths(spark, sf_dir).select("path", scalars.display_path("path", ROOT, True).alias("shown"), scalars.display_path("path", ROOT, False).alias("name"))


DUP = r"(.)(\.[^./]+)?$"
DEST = f"""WITH RECURSIVE {P},
    t AS (SELECT list(DISTINCT regexp_extract(path, '[^/]*$')) AS there FROM p WHERE page_id % 9 = 0),
    q AS (SELECT CASE WHEN page_id % 4 = 0 THEN regexp_replace(path, '{DUP}', '\\1_dup' || (page_id % 3) || '\\2') ELSE path END AS path FROM p),
    r AS (SELECT path, regexp_extract(path, '[^/]*$') AS name, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^./]+$', '\\1') AS stem,
        regexp_extract(regexp_extract(path, '[^/]*$'), '.(\\.[^./]+)$', 1) AS ending, row_number() OVER (ORDER BY path) AS i FROM q),
    walk AS (SELECT 0::BIGINT AS i, coalesce(there, []) AS taken, NULL::VARCHAR AS path, NULL::VARCHAR AS name FROM t
        UNION ALL SELECT r.i, list_append(taken, n), r.path, n FROM (SELECT r.*, taken, list_filter(list_prepend(r.name, list_transform(range(1, len(taken) + 2), lambda k: stem || '_dup' || k || ending)), lambda x: NOT list_contains(taken, x))[1] AS n
            FROM walk JOIN r ON r.i = walk.i + 1) r)
    SELECT path, '/moved/' || name AS to_path FROM walk WHERE path IS NOT NULL"""


@query(DEST)
def dest_path(spark, sf_dir):
    """Some names end like a duplicate's already, and some are taken at the destination."""
    p = paths(spark, sf_dir)
    there = p.filter("page_id % 9 = 0").select(F.concat(F.lit("/moved/"), scalars.file_name("path")).alias("path"))
    ending = F.concat(F.lit("$1_dup"), (F.col("page_id") % 3).cast("string"), F.lit("$2"))
    p = p.select(F.when(F.col("page_id") % 4 == 0, F.regexp_replace("path", F.lit(DUP), ending)).otherwise(F.col("path")).alias("path"))
    return manifest.destinations(p, config.ScanConfig(ROOT, dest_dir="/moved"), there)


# ---- caches -------------------------------------------------------------------------------

C = P + """, f AS (SELECT path, page_id * 10 AS mtime, size FROM p),
    c AS (SELECT path, CASE WHEN page_id % 5 = 0 THEN page_id * 10 + 1 ELSE page_id * 10 END AS mtime, size, CASE WHEN page_id % 7 = 0 THEN NULL ELSE page_id * 3 END AS hash FROM p WHERE page_id % 3 <> 0)"""


def stats(spark, sf_dir):
    return paths(spark, sf_dir).select("path", (F.col("page_id") * 10).alias("mtime"), "size")


def old_cache(spark, sf_dir, value="hash"):
    p = paths(spark, sf_dir).filter("page_id % 3 <> 0")
    time = F.when(F.col("page_id") % 5 == 0, F.col("page_id") * 10 + 1).otherwise(F.col("page_id") * 10)
    return p.select("path", time.alias("mtime"), "size", F.when(F.col("page_id") % 7 != 0, F.col("page_id") * 3).alias(value))


@query(f"WITH {C} SELECT f.path, f.mtime, f.size, c.hash, c.hash IS NOT NULL AS is_hit FROM f LEFT JOIN c ON f.path = c.path AND f.mtime = c.mtime AND f.size = c.size")
def hash_cache_lookup(spark, sf_dir):
    return cache.lookup(stats(spark, sf_dir), old_cache(spark, sf_dir), "hash")


@query(f"WITH {C} SELECT f.path, f.mtime, f.size, c.hash AS sharpness, c.hash IS NOT NULL AS is_hit FROM f LEFT JOIN c ON f.path = c.path AND f.mtime = c.mtime AND f.size = c.size")
def analysis_cache_lookup(spark, sf_dir):
    got = cache.lookup(stats(spark, sf_dir), old_cache(spark, sf_dir).withColumn("result", F.when(F.col("hash").isNotNull(), F.struct(F.col("hash").alias("sharpness")))).drop("hash"), "result")
    return got.select("path", "mtime", "size", "result.sharpness", "is_hit")


@query(f"WITH {C} SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.path = f.path AND c.mtime = f.mtime AND c.size = f.size AND c.hash IS NOT NULL)")
def cache_misses(spark, sf_dir):
    return cache.misses(stats(spark, sf_dir), old_cache(spark, sf_dir), "hash").select("path", "mtime", "size")


@query(f"WITH {C}, n AS (SELECT path, mtime, size, size * 2 AS hash FROM f WHERE mtime % 40 = 0) SELECT * FROM n UNION ALL SELECT * FROM c WHERE path NOT IN (SELECT path FROM n)")
def cache_upsert(spark, sf_dir):
    new = stats(spark, sf_dir).filter("mtime % 40 = 0").withColumn("hash", F.col("size") * 2)
    return cache.upsert(old_cache(spark, sf_dir), new)


# ---- fingerprints, pairs, groups ----------------------------------------------------------

FP = """tok AS (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM documents),
    h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 15))::BIGINT AS h FROM tok WHERE w <> ''),
    v AS (SELECT doc_id, b, sum(CASE WHEN (h >> b::INTEGER) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM h, range(60) r(b) GROUP BY doc_id, b),
    fp AS (SELECT doc_id, sum(CASE WHEN s > 0 THEN (1::BIGINT << b::INTEGER) ELSE 0 END)::BIGINT AS fp FROM v GROUP BY doc_id)"""
PAIRS = FP + """, e AS (SELECT a.doc_id AS src, b.doc_id AS dst, bit_count(xor(a.fp, b.fp))::BIGINT AS distance FROM fp a JOIN fp b ON a.doc_id < b.doc_id WHERE bit_count(xor(a.fp, b.fp)) <= 10)"""
COMPS = PAIRS + """, u AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e),
    walk AS (SELECT a AS node, a AS seen FROM u UNION SELECT walk.node, u.b FROM walk JOIN u ON walk.seen = u.a),
    g AS (SELECT node, min(seen) AS component FROM walk GROUP BY node),
    gi AS (SELECT node AS doc_id, dense_rank() OVER (ORDER BY component) - 1 AS group_id, row_number() OVER (PARTITION BY component ORDER BY node) - 1 AS member_idx FROM g)"""


def text_fps(spark, sf_dir):
    return fingerprints.simhash(table(spark, sf_dir, "documents"), "doc_id", "text")


def text_members(spark, sf_dir):
    fps = pairs.settled(text_fps(spark, sf_dir), "doc_id", "fp")
    return grouping.members(fps.select("doc_id"), pairs.linking_edges(fps, TEXT_T, "doc_id", bits=60), "doc_id")


VEC = """b AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE len(embedding) = 64),
    a AS (SELECT vec_id, v, list_reduce(v[2:], lambda x, y: x + y, 0.0::DOUBLE) / 63 AS m FROM b),
    fp AS (SELECT vec_id, list_reduce(list_transform(v, lambda x: (x > m)::INTEGER::HUGEINT), lambda x, y: x * 2 + y, 0::HUGEINT) AS u FROM a),
    s AS (SELECT vec_id, (CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END)::BIGINT AS fp FROM fp)"""


@query(f"WITH {VEC} SELECT vec_id, fp FROM s")
def fingerprint_bits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", fingerprints.mean_bits("embedding").alias("fp"))


@query(f"WITH {VEC} SELECT a.vec_id, b.vec_id AS other, bit_count(xor(a.fp, b.fp))::BIGINT AS distance FROM s a JOIN s b ON b.vec_id = a.vec_id + 1")
def hamming_distance(spark, sf_dir):
    v = fingerprint_bits(spark, sf_dir)
    o = v.select(F.col("vec_id").alias("other"), F.col("fp").alias("ofp"))
    return v.join(o, F.col("other") == F.col("vec_id") + 1).select("vec_id", "other", scalars.hamming("fp", "ofp").alias("distance"))


@query(f"WITH {VEC} SELECT a.vec_id AS src, b.vec_id AS dst, bit_count(xor(a.fp, b.fp))::BIGINT AS distance FROM s a JOIN s b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.fp, b.fp)) <= 20")
def neardup_pairs(spark, sf_dir):
    return pairs.all_pairs(fingerprint_bits(spark, sf_dir), VECTOR_T, "vec_id")


@query(f"WITH {PAIRS} SELECT * FROM e")
def neardup_pairs_banded(spark, sf_dir):
    return pairs.banded_pairs(pairs.settled(text_fps(spark, sf_dir), "doc_id", "fp"), TEXT_T, "doc_id", bits=60)


@query(f"WITH RECURSIVE {COMPS} SELECT node, component FROM g")
def components(spark, sf_dir):
    return connected_components(pairs.linking_edges(text_fps(spark, sf_dir), TEXT_T, "doc_id", bits=60))


@query(f"WITH RECURSIVE {COMPS} SELECT * FROM gi")
def group_index(spark, sf_dir):
    return text_members(spark, sf_dir).select("doc_id", "group_id", "member_idx")


@query(f"WITH RECURSIVE {COMPS} SELECT group_id, count(*) AS members FROM gi GROUP BY group_id HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    return text_members(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("members"))


@query(f"WITH RECURSIVE {COMPS}, x AS (SELECT * FROM gi JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id)) SELECT doc_id, group_id, member_idx FROM x WHERE group_id IN (SELECT group_id FROM x GROUP BY group_id HAVING count(*) >= 2)")
def drop_failed_analysis(spark, sf_dir):
    analysed = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return grouping.surviving(text_members(spark, sf_dir), analysed, "doc_id").select("doc_id", "group_id", "member_idx")


@query(f"WITH RECURSIVE {COMPS} SELECT unnest(ids) AS doc_id, group_id FROM (SELECT group_id, list(doc_id ORDER BY member_idx) AS ids FROM gi GROUP BY group_id)")
def flatten_members(spark, sf_dir):
    nested = text_members(spark, sf_dir).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("member_idx", "doc_id"))).alias("ms"))
    return nested.select(F.explode("ms.doc_id").alias("doc_id"), "group_id")


# ---- metrics and scores -------------------------------------------------------------------

LINES = """l AS (SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INTEGER AS member_idx,
    l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
    r AS (SELECT l_orderkey, min(l_quantity) AS ql, max(l_quantity) AS qh, min(l_extendedprice) AS pl, max(l_extendedprice) AS ph, min(l_discount) AS dl, max(l_discount) AS dh, min(l_tax) AS tl, max(l_tax) AS th FROM l GROUP BY l_orderkey),
    s AS (SELECT l_orderkey, member_idx, (0.0::DOUBLE
      + (CASE WHEN qh = ql THEN 0.0::DOUBLE ELSE (l_quantity - ql) / (qh - ql) END) * 0.35::DOUBLE
      + (CASE WHEN ph = pl THEN 0.0::DOUBLE ELSE (l_extendedprice - pl) / (ph - pl) END) * 0.2::DOUBLE
      + (1 - (CASE WHEN dh = dl THEN 0.0::DOUBLE ELSE (l_discount - dl) / (dh - dl) END)) * 0.1::DOUBLE
      + (1 - (CASE WHEN th = tl THEN 0.0::DOUBLE ELSE (l_tax - tl) / (th - tl) END)) * 0.1::DOUBLE)
      / (0.35::DOUBLE + 0.2::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE) AS score FROM l JOIN r USING (l_orderkey)),
    o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, member_idx) AS rk, lead(score) OVER (PARTITION BY l_orderkey ORDER BY score DESC, member_idx) AS next, (count(*) OVER (PARTITION BY l_orderkey))::INTEGER AS members FROM s)"""


def lines(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", (F.row_number().over(order) - 1).cast("int").alias("member_idx"), *LINE_WEIGHTS)


def scored_lines(spark, sf_dir):
    return scoring.score(lines(spark, sf_dir), "l_orderkey", LINE_WEIGHTS)


@query("SELECT l_orderkey, " + ", ".join(f"min({m}) AS {m}_lo, max({m}) AS {m}_hi, count({m}) = count(*) AS {m}_ok" for m in LINE_WEIGHTS) + " FROM lineitem GROUP BY l_orderkey")
def group_ranges(spark, sf_dir):
    return scoring.ranges(table(spark, sf_dir, "lineitem"), "l_orderkey", list(LINE_WEIGHTS))


@query(f"WITH {LINES} SELECT l_orderkey, member_idx, round(score, 6) AS quality_score FROM s")
def score_group(spark, sf_dir):
    return scored_lines(spark, sf_dir).select("l_orderkey", "member_idx", F.round("quality_score", 6).alias("quality_score"))


@query(f"WITH {LINES} SELECT l_orderkey, members, member_idx AS suggested_idx, round(score, 6) AS quality_score FROM o WHERE rk = 1")
def suggested_pick(spark, sf_dir):
    s = scored_lines(spark, sf_dir)
    best = scoring.suggested(s, "l_orderkey")
    own = s.select("l_orderkey", F.col("member_idx").alias("suggested_idx"), F.round("quality_score", 6).alias("quality_score"))
    return best.join(own, ["l_orderkey", "suggested_idx"]).select("l_orderkey", "members", "suggested_idx", "quality_score")


@query(f"WITH {LINES} SELECT l_orderkey, coalesce(score - next < 0.08::DOUBLE, false) AS is_close_call FROM o WHERE rk = 1")
def close_call(spark, sf_dir):
    return scoring.suggested(scored_lines(spark, sf_dir), "l_orderkey").select("l_orderkey", "is_close_call")


@query("""WITH d AS (SELECT documents.doc_id, documents.doc_id % 300 AS g, n_chars::DOUBLE AS n, y.quality::DOUBLE AS q, y.toxic::DOUBLE AS t FROM documents LEFT JOIN labels y USING (doc_id)),
    r AS (SELECT g, min(n) AS nl, max(n) AS nh, min(q) AS ql, max(q) AS qh, count(q) = count(*) AS qo, min(t) AS tl, max(t) AS th, count(t) = count(*) AS t_ok FROM d GROUP BY g)
    SELECT doc_id, round((0.0::DOUBLE + (CASE WHEN nh = nl THEN 0.0::DOUBLE ELSE (n - nl) / (nh - nl) END) * 0.5::DOUBLE
      + (CASE WHEN NOT qo THEN 0.0::DOUBLE ELSE (CASE WHEN qh = ql THEN 0.0::DOUBLE ELSE (q - ql) / (qh - ql) END) * 0.3::DOUBLE END)
      + (CASE WHEN NOT t_ok THEN 0.0::DOUBLE ELSE (1 - (CASE WHEN th = tl THEN 0.0::DOUBLE ELSE (t - tl) / (th - tl) END)) * 0.2::DOUBLE END))
      / (0.5::DOUBLE + (CASE WHEN qo THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN t_ok THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)), 6) AS quality_score FROM d JOIN r USING (g)""")
def score_null_metric(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("g", F.col("doc_id") % 300)
    return scoring.score(d, "g", LABEL_WEIGHTS).select("doc_id", F.round("quality_score", 6).alias("quality_score"))


@query("SELECT vec_id, round(var_pop(d), 6) AS sharpness FROM (SELECT vec_id, unnest(list_transform(range(1, 63), lambda i: embedding[i]::DOUBLE + embedding[i + 2]::DOUBLE - 2 * embedding[i + 1]::DOUBLE)) AS d FROM embeddings) GROUP BY vec_id")
def metric_sharpness(spark, sf_dir):
    """The Laplacian-variance metric on a vector as a one-dimensional signal."""
    at = lambda i: F.element_at("embedding", i).cast("double")
    second = F.transform(F.sequence(F.lit(1), F.lit(62)), lambda i: at(i) + at(i + 2) - 2 * at(i + 1))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    v = table(spark, sf_dir, "embeddings").select("vec_id", second.alias("d")).withColumn("m", mean(F.col("d")))
    return v.select("vec_id", F.round(mean(F.transform("d", lambda x: (x - F.col("m")) * (x - F.col("m")))), 6).alias("sharpness"))


@query("SELECT doc_id, length(text)::BIGINT AS chars, len(string_split(text, ' '))::BIGINT AS words, round(length(text)::DOUBLE / len(string_split(text, ' ')), 6) AS chars_per_word FROM documents")
def metric_struct(spark, sf_dir):
    chars, words = F.length("text").cast("long"), F.size(F.split("text", " ")).cast("long")
    m = F.struct(chars.alias("chars"), words.alias("words"), F.round(chars.cast("double") / words, 6).alias("chars_per_word"))
    return table(spark, sf_dir, "documents").select("doc_id", m.alias("m")).select("doc_id", "m.*")


# ---- texts --------------------------------------------------------------------------------

SIZE = "(CASE WHEN {0} < 1024 THEN printf('%.0fB', {0}::DOUBLE) WHEN {0} < 1048576 THEN printf('%.1fKB', {0}::DOUBLE / 1024) WHEN {0} < 1073741824 THEN printf('%.1fMB', {0}::DOUBLE / 1048576) ELSE printf('%.1fGB', {0}::DOUBLE / 1073741824) END)"


@query("SELECT o_orderkey, " + SIZE.format("(o_orderkey * o_orderkey * 977)") + " AS shown FROM orders")
def humansize(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.humansize(F.col("o_orderkey") * F.col("o_orderkey") * 977).alias("shown"))


@query("SELECT p_partkey, printf('%.2f', p_retailprice) AS price, printf('%.0f', p_size::DOUBLE) AS whole, CASE WHEN p_size > 40 THEN 'n/a' ELSE printf('%.3f', p_size / 8.0::DOUBLE) END AS eighths FROM part")
def metric_format(spark, sf_dir):
    size = F.when(F.col("p_size") <= 40, F.col("p_size") / 8)
    return table(spark, sf_dir, "part").select("p_partkey", scalars.fixed("p_retailprice", 2).alias("price"), scalars.fixed("p_size", 0).alias("whole"), views.shown(size, 3).alias("eighths"))


INFO = "(VALUES " + ", ".join(f"('{k}', {w}::DOUBLE, {i})" for i, (k, (w, _, _)) in enumerate(config.IMAGE_METRICS.items())) + ") t(name, weight, pos)"


@query(f"SELECT name, weight, CASE WHEN weight > 0 THEN 'higher better' ELSE 'lower better' END AS reading, (row_number() OVER (ORDER BY -abs(weight), pos))::INTEGER AS place FROM {INFO}")
def metrics_info(spark, sf_dir):
    return views.metrics_info(spark, config.IMAGE_METRICS).select("name", "weight", "reading", "place")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{label}', {1 if kind == 'score' else 0 if key is None else 1 if config.IMAGE_WEIGHTS[key] > 0 else -1}::INTEGER)" for label, key, kind in views.METRIC_ROWS) + ") t(label, direction)")
def metric_direction(spark, sf_dir):
    rows = [(label, kind, config.IMAGE_WEIGHTS.get(key)) for label, key, kind in views.METRIC_ROWS]
    return spark.createDataFrame(rows, "label string, kind string, weight double").select("label", scalars.direction("kind", "weight").alias("direction"))


def part_cells():
    return [("Size", "metric", 0.5, scalars.fixed("p_size", 0)), ("Price", "metric", -0.5, F.when(F.col("p_size") > 40, "n/a").otherwise(scalars.fixed("p_retailprice", 2))), ("Bytes", "reference", None, scalars.humansize(F.col("p_partkey") * 1000))]


CELLS = f"""c AS (SELECT p_partkey, p_brand, 0 AS row_no, 'Size' AS label, 'metric' AS kind, 1 AS direction, printf('%.0f', p_size::DOUBLE) AS value FROM part
    UNION ALL SELECT p_partkey, p_brand, 1, 'Price', 'metric', -1, CASE WHEN p_size > 40 THEN 'n/a' ELSE printf('%.2f', p_retailprice) END FROM part
    UNION ALL SELECT p_partkey, p_brand, 2, 'Bytes', 'reference', 0, {SIZE.format('(p_partkey * 1000)')} FROM part)"""


@query(f"WITH {CELLS} SELECT * FROM c")
def metrics_table(spark, sf_dir):
    return views.unpivoted(table(spark, sf_dir, "part"), ["p_partkey", "p_brand"], part_cells())


@query(f"WITH {CELLS}, n AS (SELECT *, try_cast(value AS DOUBLE) AS v FROM c), t AS (SELECT p_brand, label, max(v) AS hi, min(v) AS lo, count(v) AS k FROM n GROUP BY p_brand, label) SELECT p_partkey, p_brand, label, coalesce(direction <> 0 AND k >= 2 AND v = CASE WHEN direction > 0 THEN hi ELSE lo END, false) AS is_best FROM n JOIN t USING (p_brand, label)")
def best_cells(spark, sf_dir):
    t = views.unpivoted(table(spark, sf_dir, "part"), ["p_partkey", "p_brand"], part_cells())
    return views.best_cells(t, "p_brand").select("p_partkey", "p_brand", "label", "is_best")


@query(f"WITH {CELLS} SELECT row_no, label, max(value) FILTER (p_partkey = 1) AS value_a, max(value) FILTER (p_partkey = 2) AS value_b FROM c WHERE p_partkey IN (1, 2) GROUP BY row_no, label")
def pairwise_report(spark, sf_dir):
    return views.pairwise_report(table(spark, sf_dir, "part"), "p_partkey", 1, 2, part_cells())


# ---- review state -------------------------------------------------------------------------

STATE = """e AS (SELECT user_id AS group_id, event_id, CASE event_type WHEN 'click' THEN 'pick' WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'skip' ELSE 'none' END AS action, floor(value)::BIGINT AS value FROM events),
    w AS (SELECT *, max(event_id) FILTER (action = 'confirm') OVER (PARTITION BY group_id) AS last FROM e),
    a AS (SELECT group_id, count(*) FILTER (action = 'skip' AND (last IS NULL OR event_id > last)) AS k, max(last) AS last, arg_max(value, event_id) FILTER (action = 'pick') AS pick, count(*) AS actions FROM w GROUP BY group_id),
    st AS (SELECT group_id, CASE WHEN k % 2 = 1 THEN 'skipped' WHEN k > 0 THEN 'pending' WHEN last IS NOT NULL THEN 'confirmed' ELSE 'pending' END AS status, pick, actions FROM a)"""


def states(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    action = F.when(e["event_type"] == "click", "pick").when(e["event_type"] == "purchase", "confirm").when(e["event_type"] == "error", "skip").otherwise("none")
    return review.replay(e.select(F.col("user_id").alias("group_id"), F.col("event_id").alias("seq"), action.alias("action"), F.floor("value").cast("long").alias("value")))


@query(f"WITH {STATE} SELECT * FROM st")
def state_replay(spark, sf_dir):
    return states(spark, sf_dir)


@query(f"WITH {STATE} SELECT group_id, pick FROM st WHERE status = 'pending'")
def auto_pending(spark, sf_dir):
    return states(spark, sf_dir).filter("status = 'pending'").select("group_id", "pick")


@query(f"WITH {STATE} SELECT count(*) AS total, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'pending') AS pending FROM st")
def status_counts(spark, sf_dir):
    return views.status_counts(states(spark, sf_dir))


@query(f"WITH {STATE} SELECT arg_min(group_id, ((group_id - 20 - 1) % 1000 + 1000) % 1000) AS next_group FROM st WHERE status = 'pending'")
def next_pending(spark, sf_dir):
    return review.next_pending(states(spark, sf_dir), 20, 1000)


@query(f"WITH {STATE} SELECT group_id, (((coalesce(pick, 0) - 3) % 5 + 5) % 5)::BIGINT AS pick FROM st")
def pick_relative(spark, sf_dir):
    s = states(spark, sf_dir).select("group_id", F.coalesce("pick", F.lit(0)).alias("pick"), F.lit(-3).alias("delta"), F.lit(5).alias("members"))
    return s.select("group_id", review.pick_relative("pick", "delta", "members").cast("long").alias("pick"))


@query("WITH t AS (SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id))::BIGINT AS done, count(*) OVER (PARTITION BY event_type) AS total FROM events) SELECT * FROM t WHERE done % 100 = 0 OR done = total")
def progress_ticks(spark, sf_dir):
    e = grouping.ranked(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id", "at")
    total = e.groupBy("event_type").agg(F.count("*").alias("total"))
    e = e.join(total, "event_type").select("event_type", (F.col("at") + 1).alias("done"), "total")
    return views.progress_ticks(e, "done", "total")


GROUPS = M + ", gr AS (SELECT group_id, max(n) AS members, max(pick) AS pick, CASE WHEN group_id % 3 = 0 THEN 'pending' WHEN group_id % 3 = 1 THEN 'confirmed' ELSE 'skipped' END AS status, group_id % 4 = 0 AS close FROM k GROUP BY group_id)"


def page_groups(spark, sf_dir):
    m = page_members(spark, sf_dir)
    status = F.when(F.col("group_id") % 3 == 0, "pending").when(F.col("group_id") % 3 == 1, "confirmed").otherwise("skipped")
    return m.groupBy("group_id").agg(F.max("n").alias("members"), F.max("pick").alias("pick")).withColumn("status", status).withColumn("close", F.col("group_id") % 4 == 0)


@query(f"WITH {GROUPS} SELECT group_id, members, pick, status, close AS is_close_call, 0 AS suggested_idx FROM gr")
def group_summary(spark, sf_dir):
    return page_groups(spark, sf_dir).select("group_id", "members", "pick", "status", F.col("close").alias("is_close_call"), F.lit(0).alias("suggested_idx"))


@query(f"WITH {GROUPS} SELECT group_id, CASE status WHEN 'pending' THEN '◻' WHEN 'confirmed' THEN '✔' ELSE '—' END || ' Group ' || (group_id + 1) || ' (' || members || ' files)' || CASE WHEN close THEN ' ⚠' ELSE '' END || CASE WHEN status = 'confirmed' THEN ' → [' || (pick + 1) || ']' ELSE '' END AS label FROM gr")
def group_label(spark, sf_dir):
    return page_groups(spark, sf_dir).select("group_id", views.group_label("group_id", "members", "status", "close", "pick").alias("label"))


@query(f"""WITH {GROUPS}, a AS (SELECT group_id, max(path) FILTER (member_idx = pick) AS pp, max(path) FILTER (member_idx = 0) AS sp FROM k GROUP BY group_id),
    c AS (SELECT 'Groups: ' || count(*) || '  confirmed=' || count(*) FILTER (status = 'confirmed') || '  skipped=' || count(*) FILTER (status = 'skipped') || '  pending=' || count(*) FILTER (status = 'pending') AS head FROM gr),
    t AS (SELECT group_id, status, head, 'keep [' || (pick + 1) || '] ' || pp || CASE WHEN members > 1 THEN ', move ' || (members - 1) || ' other file' || CASE WHEN members <> 2 THEN 's' ELSE '' END ELSE '' END AS act,
        CASE WHEN pick <> 0 THEN 'your pick [' || (pick + 1) || ']  ·  ★ suggested [1] ' || sp ELSE '' END AS differs FROM gr JOIN a USING (group_id), c)
    SELECT group_id, head || chr(10) || CASE WHEN status = 'pending' THEN act || chr(10) || differs
        WHEN status = 'confirmed' AND group_id % 2 = 1 THEN 'change ' || act || '  (press c/Enter to confirm)' || chr(10) || differs ELSE 'already ' || status || chr(10) END AS status_text FROM t""")
def status_text(spark, sf_dir):
    m = page_members(spark, sf_dir)
    path_of = lambda i: F.max(F.when(F.col("member_idx") == i, F.col("path")))
    names = m.groupBy("group_id").agg(path_of(F.col("pick")).alias("pick_name"), path_of(F.lit(0)).alias("suggested_name"))
    g = page_groups(spark, sf_dir).join(names, "group_id").withColumn("suggested", F.lit(0)).withColumn("needs_reapply", F.col("group_id") % 2 == 1)
    return views.status_text(g)


# ---- manifest -----------------------------------------------------------------------------

MOVES = M + """, kept AS (SELECT group_id, path AS kept FROM k WHERE member_idx = pick),
    v0 AS (SELECT k.group_id, kept, path, size, member_idx, regexp_replace(path, '^.*/', '') AS name FROM k JOIN kept USING (group_id) WHERE path <> kept),
    v1 AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY group_id, member_idx) - 1 AS d FROM v0),
    mv AS (SELECT group_id, kept, path AS from_path, '/moved/' || CASE WHEN d = 0 THEN name ELSE regexp_replace(name, '(.)\\.[^./]+$', '\\1') || '_dup' || d || regexp_extract(name, '.(\\.[^./]+)$', 1) END AS to_path, size, false AS dry_run FROM v1)"""


def page_moves(spark, sf_dir):
    m = page_members(spark, sf_dir)
    return manifest.move_plan(m.select("group_id", "member_idx", "path", "size"), picks(m), config.ScanConfig(ROOT, dest_dir="/moved"))


@query(f"WITH {MOVES} SELECT * FROM mv")
def move_plan(spark, sf_dir):
    return page_moves(spark, sf_dir)


@query(f"WITH {M}, x AS (SELECT *, CASE WHEN page_id % 4 = 0 THEN '/real/' || host ELSE path END AS resolved FROM k), y AS (SELECT group_id, path AS kept, resolved AS r FROM x WHERE member_idx = pick) SELECT x.group_id, path AS from_path FROM x JOIN y USING (group_id) WHERE path <> kept AND NOT (r <> kept AND resolved = r)")
def symlink_skip(spark, sf_dir):
    m = page_members(spark, sf_dir)
    real = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/real/"), "host")).otherwise(F.col("path"))
    plan = manifest.move_plan(m.withColumn("resolved", real).select("group_id", "member_idx", "path", "size", "resolved"), picks(m), config.ScanConfig(ROOT, dest_dir="/moved"))
    return plan.select("group_id", "from_path")


@query(f"WITH {MOVES} SELECT coalesce(sum(size), 0)::BIGINT AS bytes_reclaimed, count(*) AS files FROM mv")
def bytes_reclaimed(spark, sf_dir):
    sizes = paths(spark, sf_dir).select(F.col("path").alias("from_path"), F.col("size").alias("known"))
    m = page_moves(spark, sf_dir).drop("size").join(sizes, "from_path", "left")
    return m.agg(F.coalesce(F.sum(F.coalesce("known", F.lit(0))), F.lit(0)).cast("long").alias("bytes_reclaimed"), F.count("*").alias("files"))


@query(f"WITH {MOVES}, t AS (SELECT group_id, count(*) AS c FROM mv GROUP BY group_id) SELECT coalesce(sum(c), 0)::BIGINT AS moved_total FROM t")
def moved_total(spark, sf_dir):
    entries = page_moves(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("moved"))
    return entries.agg(F.coalesce(F.sum("moved"), F.lit(0)).cast("long").alias("moved_total"))


@query(f"WITH {MOVES} SELECT * FROM mv WHERE group_id % 3 <> 1")
def clear_stale_manifest(spark, sf_dir):
    stale = page_groups(spark, sf_dir).filter("status = 'confirmed'")
    return manifest.without_group(page_moves(spark, sf_dir), stale)


@query(f"WITH {MOVES} SELECT from_path, to_path, CASE WHEN group_id % 5 = 0 THEN 'drop' WHEN size % 2 = 0 AND size % 3 <> 0 THEN 'restore' ELSE 'keep' END AS action FROM mv")
def unapply_plan(spark, sf_dir):
    m = page_moves(spark, sf_dir).withColumn("dry_run", F.col("group_id") % 5 == 0)
    here = m.filter("size % 2 = 0").select(F.col("to_path").alias("path")).unionByName(m.filter("size % 3 = 0").select(F.col("from_path").alias("path")))
    return manifest.unapply_plan(m, here).select("from_path", "to_path", "action")


@query(f"WITH {M}, g AS (SELECT group_id, max(path) FILTER (member_idx = pick) AS pick_path, max(path) FILTER (member_idx = 0) AS kept FROM k GROUP BY group_id) SELECT group_id, pick_path, CASE WHEN group_id % 4 = 0 THEN NULL ELSE kept END AS kept, CASE WHEN group_id % 4 = 0 THEN true ELSE kept <> pick_path END AS needs_reapply FROM g")
def needs_reapply(spark, sf_dir):
    m = page_members(spark, sf_dir)
    path_of = lambda i: F.max(F.when(F.col("member_idx") == i, F.col("path")))
    groups = m.groupBy("group_id").agg(path_of(F.col("pick")).alias("pick_path"))
    entries = m.filter("group_id % 4 <> 0 AND member_idx IN (0, 1)").select("group_id", F.col("member_idx").alias("entry_no"), F.col("path").alias("kept"))
    return manifest.needs_reapply(groups, entries)


@query(f"WITH {MOVES}, t AS (SELECT group_id, count(*) AS f, sum(size) AS b, group_id % 7 = 3 AS bad FROM mv GROUP BY group_id) SELECT count(*) FILTER (NOT bad) AS confirmed, count(*) FILTER (bad) AS failed, coalesce(sum(f), 0)::BIGINT AS files_moved, coalesce(sum(b) FILTER (NOT bad), 0)::BIGINT AS bytes_reclaimed FROM t")
def auto_summary(spark, sf_dir):
    t = page_moves(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("files_moved"), F.sum("size").alias("bytes_moved"))
    return manifest.auto_summary(t.withColumn("error", F.when(F.col("group_id") % 7 == 3, "disk full")).withColumn("dry_run", F.lit(False)))


# ---- flagship -----------------------------------------------------------------------------


def flagship(spark, sf_dir):
    """Near-duplicate documents: groups, scored members, suggestion and close calls."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, sf_dir, "labels")
    metrics = docs.select("doc_id").join(labels.dropDuplicates(["doc_id"]), "doc_id", "left").select("doc_id", "quality", "toxic")
    groups, scored = pipeline.build_groups(docs, text_fps(spark, sf_dir), metrics, LABEL_WEIGHTS, TEXT_T, "doc_id", bits=60)
    return scored.join(groups, "group_id").select("group_id", "member_idx", "doc_id", "source", F.round("quality_score", 6).alias("quality_score"), (F.col("member_idx") == F.col("suggested_idx")).alias("is_suggested"), "is_close_call")


REVIEW = f"""WITH RECURSIVE {COMPS},
    d AS (SELECT gi.*, documents.source, n_chars::DOUBLE AS n, y.quality::DOUBLE AS q, y.toxic::DOUBLE AS t FROM gi JOIN documents USING (doc_id) LEFT JOIN labels y USING (doc_id)),
    z AS (SELECT group_id, min(n) AS nl, max(n) AS nh, min(q) AS ql, max(q) AS qh, count(q) = count(*) AS qo, min(t) AS tl, max(t) AS th, count(t) = count(*) AS t_ok FROM d GROUP BY group_id),
    s AS (SELECT d.*, (0.0::DOUBLE + (CASE WHEN nh = nl THEN 0.0::DOUBLE ELSE (n - nl) / (nh - nl) END) * 0.5::DOUBLE
      + (CASE WHEN NOT qo THEN 0.0::DOUBLE ELSE (CASE WHEN qh = ql THEN 0.0::DOUBLE ELSE (q - ql) / (qh - ql) END) * 0.3::DOUBLE END)
      + (CASE WHEN NOT t_ok THEN 0.0::DOUBLE ELSE (1 - (CASE WHEN th = tl THEN 0.0::DOUBLE ELSE (t - tl) / (th - tl) END)) * 0.2::DOUBLE END))
      / (0.5::DOUBLE + (CASE WHEN qo THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN t_ok THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)) AS score FROM d JOIN z USING (group_id)),
    o AS (SELECT *, row_number() OVER best AS rk, lead(score) OVER best AS next FROM s WINDOW best AS (PARTITION BY group_id ORDER BY score DESC, member_idx))
    SELECT group_id, member_idx, doc_id, source, round(score, 6) AS quality_score, rk = 1 AS is_suggested,
      coalesce(max(CASE WHEN rk = 1 THEN score - next END) OVER (PARTITION BY group_id) < 0.08::DOUBLE, false) AS is_close_call FROM o"""

QUERIES["near_duplicate_review"], ORACLES["near_duplicate_review"] = flagship, REVIEW
