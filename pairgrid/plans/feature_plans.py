"""Feature queries (F1–F9, P23, G17, J4, J5) and the sparse-text sinks and scan (K2, K3, A5)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from pairgrid.operators import features as FT
from pairgrid.operators.curate import join_left_features, join_match_check, log_ratio_scale
from pairgrid.operators.report import all_zero_columns, all_zero_rows
from pairgrid.plans import design as D
from pairgrid.plans.curation import EDGES_SQL
from pairgrid.plans.roles import OBS_SQL, load, observations, with_sql
from pairgrid.sources import readers as R
from pairgrid.sources import writers as K

# The key dictionary (F3), one regex per bit, over a
# chemical's "name type brand" text.
KEY_PATTERNS = [
    r"\bring\b", r"\bbolt\b", r"\bgear\b", r"\bwidget\b", r"\bgizmo\b", r"\bplate\b", r"\brod\b",
    r"^small ", r"^large ", r"^red ", r"^blue ", r"^hot ", r"^old ",
    r"ECONOMY", r"STANDARD", r"PROMO", r"Brand#1[0-9]\b", r"Brand#2[0-9]\b", r"Brand#[0-9]\b",
]


def q_hashed_count_fingerprint(spark, sf_dir):
    return D.chem_fingerprint(spark, sf_dir, observations(spark, sf_dir))


def doc_fingerprint(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return FT.hashed_count_fingerprint(docs, "doc_id", "text", D.N_BITS, (1, 2))


def q_hashed_count_fingerprint_docs(spark, sf_dir):
    return doc_fingerprint(spark, sf_dir)


def chem_keys(spark, sf_dir):
    return FT.key_fingerprint(D.chem_text(spark, sf_dir, observations(spark, sf_dir)), "chem", "text", KEY_PATTERNS)


def q_key_fingerprint(spark, sf_dir):
    return chem_keys(spark, sf_dir).select("chem", "bit")


def q_scale_fingerprint(spark, sf_dir):
    fp = D.chem_fingerprint(spark, sf_dir, observations(spark, sf_dir))
    s = log_ratio_scale(fp, "bit", "cnt", "val")
    return s.select("chem", "bit", F.round("val", 6).alias("val"))


def q_log_ratio_scale(spark, sf_dir):
    s = log_ratio_scale(doc_fingerprint(spark, sf_dir), "bit", "cnt", "val")
    return s.select("doc_id", "bit", F.round("val", 6).alias("val"))


def q_all_zero_rows(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return all_zero_rows(D.chem_text(spark, sf_dir, obs), chem_keys(spark, sf_dir), "chem")


def q_all_zero_columns(spark, sf_dir):
    fp = D.chem_fingerprint(spark, sf_dir, observations(spark, sf_dir))
    bits = spark.range(D.N_BITS).select(F.col("id").cast("int").alias("bit"))
    return all_zero_columns(bits, fp, "bit")


def q_one_hot(spark, sf_dir):
    c = D.coded_observations(spark, sf_dir)
    lg, _ = D.design_long(c, ["species", "chem", "dur"])
    return lg.select("idx", "feature")


def q_field_map(spark, sf_dir):
    c = D.coded_observations(spark, sf_dir)
    names = D.blocks("LM4", "setting1")
    return FT.field_map(spark, D.block_sizes(c, names))


def q_interaction_terms(spark, sf_dir):
    c = D.coded_observations(spark, sf_dir)
    it = FT.interaction_terms(c.rows, "idx", "sp_code", "chem", c.fp, D.N_BITS)
    return it.select("idx", "feature", F.round("val", 6).alias("val"))


def lm4_vectors(spark, sf_dir):
    c = D.coded_observations(spark, sf_dir)
    rows, width = D.design_arrays(c, D.blocks("LM4", "setting1"), ["idx"])
    return c, FT.vectors_from_arrays(rows, ["idx"], width), width


def q_stack_blocks(spark, sf_dir):
    """species | chemical | duration indicator vectors + fingerprint vector, assembled."""
    c = D.coded_observations(spark, sf_dir)
    df = c.rows.select("idx", "sp_code", "du_code", "ch_code", "chem")
    # a block's vector is built once for each of its values, and rows look theirs up
    for name, key in [("species", "sp_code"), ("dur", "du_code"), ("chem", "ch_code"), ("fp", "chem")]:
        values = c.rows.select("chem" if name == "fp" else key).distinct().withColumn("idx", F.col(key))
        lg, w = D.design_long(replace(c, rows=values), [name])
        v = FT.vectors_from_long(lg, "idx", w, out=f"v_{name}").withColumnRenamed("idx", "_key")
        df = df.join(v, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    st = FT.stack_blocks(df.na.drop(subset=[f"v_{n}" for n in ["species", "chem", "dur"]]),
                         [f"v_{n}" for n in ["species", "chem", "dur", "fp"]])
    # a sparse vector's stored entries, never widened: its zeros count nothing
    u = st.select("idx", F.unwrap_udt("features").alias("_u"))
    stored = F.col("_u.values")
    return u.select("idx", F.when(F.col("_u.type") == 0, F.col("_u.size")).otherwise(F.size(stored)).alias("width"),
                    F.size(F.filter(stored, lambda x: x != 0)).alias("nnz"),
                    F.round(F.aggregate(stored, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def q_to_long_sparse(spark, sf_dir):
    _, vec, _ = lm4_vectors(spark, sf_dir)
    lg = FT.to_long_sparse(vec, "idx", "features")
    return lg.select("idx", "feature", F.round("val", 6).alias("val"))


def q_join_left_features(spark, sf_dir):
    obs = observations(spark, sf_dir)
    fp = D.chem_fingerprint(spark, sf_dir, obs)
    j = join_left_features(obs.select("idx", "chem"), fp, "chem")
    return j.groupBy("idx").agg(F.count("bit").alias("n_bits"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_tokens"))


def q_join_match_check(spark, sf_dir):
    return join_match_check(observations(spark, sf_dir).select("idx", "chem"), chem_keys(spark, sf_dir), "chem")


def _lm4_long_with_label(spark, sf_dir):
    c = D.coded_observations(spark, sf_dir)
    codes = ["sp_code", "ch_code", "du_code"]
    rows, width = D.design_arrays(c, D.blocks("LM4", "setting1"), ["idx", "y", *codes], empty=True)
    entry = lambda at, val: F.struct(at.cast("int").alias("feature"), val.alias("val"))
    # a null code is an entry without a feature
    unknown = F.filter(F.array(*[F.when(F.col(k).isNull(), entry(F.lit(None), F.lit(1.0))) for k in codes]), lambda x: x.isNotNull())
    e = F.array_sort(F.concat(F.zip_with("fi", "fv", entry), unknown))
    return c, rows.select("idx", e.alias("e"), "y").where(F.size("e") > 0), width


def _lines_back(spark, path):
    """The lines as they stand in the files. Those were written in order of idx, which is
    dense from 0, so a line's place is its idx; a lost or doubled line shifts the rest."""
    return R.numbered_lines(spark, path).select(F.col("row_id").alias("idx"), F.col("value").alias("line"))


def q_write_libsvm(spark, sf_dir):
    _, g, _ = _lm4_long_with_label(spark, sf_dir)
    rows = g.select("idx", "y", F.col("e.feature").alias("fi"), F.col("e.val").alias("fv"))
    path = K.scratch_path(spark, "libsvm")
    K.write_libsvm(rows.repartitionByRange("idx"), "y", "fi", "fv", path, ["idx"])
    return _lines_back(spark, path)


def q_write_libffm(spark, sf_dir):
    c, g, _ = _lm4_long_with_label(spark, sf_dir)
    sizes = D.block_sizes(c, D.blocks("LM4", "setting1"))
    bounds = F.array(*[F.lit(sum(sizes[: i + 1])) for i in range(len(sizes))])
    # field of a feature = number of block ends at or below it
    rows = g.select("idx", "y", F.col("e.feature").alias("fi"), F.col("e.val").alias("fv"),
                    F.transform("e", lambda x: F.size(F.filter(bounds, lambda b: b <= x["feature"]))).alias("ff"))
    path = K.scratch_path(spark, "libffm")
    K.write_libffm(rows.repartitionByRange("idx"), "y", "ff", "fi", "fv", path, ["idx"])
    return _lines_back(spark, path)


def q_scan_sparse_rows(spark, sf_dir):
    _, g, _ = _lm4_long_with_label(spark, sf_dir)
    rows = g.select("idx", "y", F.col("e.feature").alias("fi"), F.col("e.val").alias("fv"))
    path = K.scratch_path(spark, "libsvm_scan")
    K.write_libsvm(rows, "y", "fi", "fv", path)
    sp = R.scan_sparse_rows(spark, path)
    lg = sp.select(F.explode(F.arrays_zip("idx", "val")).alias("e")).select("e.idx", "e.val")
    return lg.groupBy(F.col("idx").alias("feature")).agg(F.count(F.lit(1)).alias("n_rows"),
                                                         F.round(F.sum("val"), 4).alias("sum_val"))


def q_user_fingerprint(spark, sf_dir):
    """A user pandas function per distinct chemical (letter counts of its text)."""
    ct = D.chem_text(spark, sf_dir, observations(spark, sf_dir, index=False))
    return FT.fingerprint(ct, "chem", "text", FT.letter_counts, 26)


def q_rbf_landmark_map(spark, sf_dir):
    emb = load(spark, sf_dir, "embeddings")
    phi = FT.rbf_landmark_map(emb, "vec_id", "embedding", 32, 0.05)
    return phi.select("vec_id", F.size("phi").alias("m"),
                      F.round(F.sqrt(F.aggregate("phi", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


QUERIES = {
    "hashed_count_fingerprint": q_hashed_count_fingerprint,
    "hashed_count_fingerprint_docs": q_hashed_count_fingerprint_docs,
    "key_fingerprint": q_key_fingerprint,
    "scale_fingerprint": q_scale_fingerprint,
    "log_ratio_scale": q_log_ratio_scale,
    "all_zero_rows": q_all_zero_rows,
    "all_zero_columns": q_all_zero_columns,
    "one_hot": q_one_hot,
    "field_map": q_field_map,
    "interaction_terms": q_interaction_terms,
    "stack_blocks": q_stack_blocks,
    "to_long_sparse": q_to_long_sparse,
    "join_left_features": q_join_left_features,
    "join_match_check": q_join_match_check,
    "write_libsvm": q_write_libsvm,
    "write_libffm": q_write_libffm,
    "scan_sparse_rows": q_scan_sparse_rows,
    "rbf_landmark_map": q_rbf_landmark_map,
    "user_fingerprint": q_user_fingerprint,
}


# --- DuckDB oracles -------------------------------------------------------------------

_TOK = "list_transform(list_filter(string_split_regex({t}, '[^A-Za-z0-9]+'), lambda s: s <> ''), lambda s: lower(s))"


def _bucket(x: str, n: int = D.N_BITS) -> str:
    return f"CAST(CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT) % {n} AS INTEGER)"


CHEM_TEXT_SQL = """
ctext AS (SELECT p_partkey AS chem, concat_ws(' ', p_name, p_type, p_brand) AS text FROM part
          WHERE p_partkey IN (SELECT chem FROM obs))"""

FP_SQL = f"""
toks AS (SELECT chem, unnest({_TOK.format(t='text')}) AS g FROM ctext),
fp AS (SELECT chem, {_bucket('g')} AS bit, CAST(count(*) AS INTEGER) AS cnt FROM toks GROUP BY ALL),
fps AS (SELECT chem, bit, ln(1 + cnt) / max(ln(1 + cnt)) OVER (PARTITION BY bit) AS val FROM fp)"""

DOC_FP_SQL = f"""
dt AS (SELECT doc_id, {_TOK.format(t='text')} AS t FROM documents),
dg AS (SELECT doc_id, unnest(t) AS g FROM dt
       UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: array_to_string(t[i:i + 1], ' ')))
       FROM dt),
dfp AS (SELECT doc_id, {_bucket('g')} AS bit, CAST(count(*) AS INTEGER) AS cnt FROM dg GROUP BY ALL)"""


def _regex_sql(p: str) -> str:
    return p.replace("'", "''")


KEYS_SQL = "keys AS (" + " UNION ALL ".join(
    f"SELECT chem, {i} AS bit FROM ctext WHERE regexp_matches(text, '{_regex_sql(p)}')"
    for i, p in enumerate(KEY_PATTERNS)) + ")"

CODES_SQL = """
sizes AS (SELECT count(DISTINCT species) AS ns, count(DISTINCT chem) AS nc,
                 (SELECT count(*) FROM edges) - 1 AS nb FROM obs),
codes AS (SELECT o.idx, o.y, o.chem, b.dur_bin - 1 AS du_code,
                 dense_rank() OVER (ORDER BY o.species) - 1 AS sp_code,
                 dense_rank() OVER (ORDER BY o.chem) - 1 AS ch_code
          FROM obs o JOIN binned b USING (idx))"""

DESIGN4_SQL = """
design AS (
  SELECT idx, CAST(sp_code AS INTEGER) AS feature, 1.0 AS val FROM codes
  UNION ALL SELECT idx, CAST(ns + ch_code AS INTEGER), 1.0 FROM codes, sizes
  UNION ALL SELECT idx, CAST(ns + nc + du_code AS INTEGER), 1.0 FROM codes, sizes
  UNION ALL SELECT c.idx, CAST(ns + nc + nb + f.bit AS INTEGER), f.val FROM codes c JOIN fps f USING (chem), sizes)"""

_FEAT_BASE = (OBS_SQL, EDGES_SQL, CHEM_TEXT_SQL, FP_SQL, CODES_SQL)


def _libsvm_line_sql(with_field: bool) -> str:
    if with_field:
        body = ("list_transform(list_sort(list(struct_pack(f := feature, v := val, fl := field))), "
                "lambda e: printf('%d:%d:%.4f', e.fl, e.f, e.v))")
    else:
        body = "list_transform(list_sort(list(struct_pack(f := feature, v := val))), lambda e: printf('%d:%.4f', e.f, e.v))"
    return f"printf('%.4f', any_value(y)) || ' ' || array_to_string({body}, ' ')"


_LETTERS = "abcdefghijklmnopqrstuvwxyz"

ORACLES = {
    "user_fingerprint": with_sql(OBS_SQL, CHEM_TEXT_SQL) + "SELECT chem, bit, cnt FROM (" + " UNION ALL ".join(
        f"SELECT chem, {i} AS bit, CAST(length(lower(text)) - length(replace(lower(text), '{c}', '')) AS INTEGER) AS cnt "
        f"FROM ctext" for i, c in enumerate(_LETTERS)) + ") WHERE cnt <> 0",
    "hashed_count_fingerprint": with_sql(OBS_SQL, CHEM_TEXT_SQL, FP_SQL) + "SELECT chem, bit, cnt FROM fp",
    "hashed_count_fingerprint_docs": with_sql(DOC_FP_SQL) + "SELECT doc_id, bit, cnt FROM dfp",
    "key_fingerprint": with_sql(OBS_SQL, CHEM_TEXT_SQL, KEYS_SQL) + "SELECT chem, bit FROM keys",
    "scale_fingerprint": with_sql(OBS_SQL, CHEM_TEXT_SQL, FP_SQL) + "SELECT chem, bit, round(val, 6) AS val FROM fps",
    "log_ratio_scale": with_sql(DOC_FP_SQL)
    + "SELECT doc_id, bit, round(ln(1 + cnt) / max(ln(1 + cnt)) OVER (PARTITION BY bit), 6) AS val FROM dfp",
    "all_zero_rows": with_sql(OBS_SQL, CHEM_TEXT_SQL, KEYS_SQL)
    + "SELECT DISTINCT chem FROM ctext WHERE chem NOT IN (SELECT chem FROM keys)",
    "all_zero_columns": with_sql(OBS_SQL, CHEM_TEXT_SQL, FP_SQL)
    + f"SELECT CAST(range AS INTEGER) AS bit FROM range(0, {D.N_BITS}) WHERE range NOT IN (SELECT bit FROM fp)",
    "one_hot": with_sql(*_FEAT_BASE)
    + "SELECT idx, CAST(sp_code AS INTEGER) AS feature FROM codes "
      "UNION ALL SELECT idx, CAST(ns + ch_code AS INTEGER) FROM codes, sizes "
      "UNION ALL SELECT idx, CAST(ns + nc + du_code AS INTEGER) FROM codes, sizes",
    "field_map": with_sql(OBS_SQL, EDGES_SQL, CODES_SQL)
    + f"""SELECT CAST(f AS INTEGER) AS feature, CAST(CASE WHEN f < ns THEN 0 WHEN f < ns + nc THEN 1
              WHEN f < ns + nc + nb THEN 2 ELSE 3 END AS INTEGER) AS field
          FROM sizes, range(0, ns + nc + nb + {D.N_BITS}) t(f)""",
    "interaction_terms": with_sql(*_FEAT_BASE)
    + f"SELECT c.idx, CAST(c.sp_code * {D.N_BITS} + f.bit AS INTEGER) AS feature, round(f.val, 6) AS val "
      "FROM codes c JOIN fps f USING (chem)",
    "stack_blocks": with_sql(*_FEAT_BASE, DESIGN4_SQL)
    + f"SELECT idx, CAST(max(ns + nc + nb + {D.N_BITS}) AS INTEGER) AS width, CAST(count(*) AS INTEGER) AS nnz, "
      "round(sum(val), 6) AS total FROM design, sizes GROUP BY idx",
    "to_long_sparse": with_sql(*_FEAT_BASE, DESIGN4_SQL) + "SELECT idx, feature, round(val, 6) AS val FROM design",
    "join_left_features": with_sql(OBS_SQL, CHEM_TEXT_SQL, FP_SQL)
    + "SELECT o.idx, count(f.bit) AS n_bits, coalesce(sum(f.cnt), 0) AS n_tokens FROM obs o "
      "LEFT JOIN fp f USING (chem) GROUP BY o.idx",
    "join_match_check": with_sql(OBS_SQL, CHEM_TEXT_SQL, KEYS_SQL)
    + "SELECT count(*) AS n_rows, count(k.hit) AS n_matched, CAST(sum(CASE WHEN k.hit IS NULL THEN 1 ELSE 0 END) AS BIGINT) "
      "AS n_missing FROM obs o LEFT JOIN (SELECT DISTINCT chem, 1 AS hit FROM keys) k USING (chem)",
    "write_libsvm": with_sql(*_FEAT_BASE, DESIGN4_SQL)
    + f"SELECT d.idx, {_libsvm_line_sql(False)} AS line FROM design d JOIN codes c USING (idx) GROUP BY d.idx",
    "write_libffm": with_sql(*_FEAT_BASE, DESIGN4_SQL)
    + ", fd AS (SELECT d.*, CASE WHEN feature < ns THEN 0 WHEN feature < ns + nc THEN 1 WHEN feature < ns + nc + nb "
      "THEN 2 ELSE 3 END AS field FROM design d, sizes) "
    + f"SELECT fd.idx, {_libsvm_line_sql(True)} AS line FROM fd JOIN codes c USING (idx) GROUP BY fd.idx",
    "scan_sparse_rows": with_sql(*_FEAT_BASE, DESIGN4_SQL)
    + "SELECT feature, count(*) AS n_rows, round(sum(round(val, 4)), 4) AS sum_val FROM design GROUP BY feature",
}
