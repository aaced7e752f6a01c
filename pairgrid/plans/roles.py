"""Stand-ins for the reference's tables, derived from the driver tables.

The reference's raw data is not shipped, so every role is played by a
deterministic derivation of the TPC-H-like tables (see README, "Roles").
Each builder has a DuckDB twin (``*_SQL``) used by the oracles; the two
must stay in step.

Code columns (units, habitats, endpoints, ...) are functions of non-key
attributes, so every row of every table flows into every query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgrid.functions.columns import int_fold, int_fold_sql
from pairgrid.operators.reshape import global_row_index
from pairgrid.session import table_path

K_FOLDS = 5
INNER_SALT = "inner"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


# --- row identity --------------------------------------------------------------
# No column set short of the whole row is unique in the line items, so the
# row id is built as the reference builds it: a dense index in a seeded
# shuffle order (W2). The order hashes the integer keys and breaks ties on
# the remaining columns.

LI_HASH_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LI_TIEBREAK = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ROW_SEED = "42"


def index_buckets(df: DataFrame) -> int:
    """Hash ranges for the row index: they grow with the input (one per scan split at
    least), so no bucket outgrows a task; the offset table stays one row per bucket."""
    spark = df.sparkSession
    return max(4096, int(spark.conf.get("spark.sql.shuffle.partitions", "200")), df.rdd.getNumPartitions())


def lineitem_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return global_row_index(li, LI_HASH_KEYS, ROW_SEED, index_buckets(li), LI_TIEBREAK, out="idx")


LI_SQL = f"""
li AS (
  SELECT *, CAST(row_number() OVER (ORDER BY
           CAST(('0x' || substr(md5(concat(concat_ws('|', {", ".join(f"CAST({c} AS VARCHAR)" for c in LI_HASH_KEYS)}),
                                          '#{ROW_SEED}')), 1, 8)) AS BIGINT),
           {", ".join(LI_HASH_KEYS + LI_TIEBREAK)}) - 1 AS BIGINT) AS idx
  FROM lineitem
)"""


# --- observations: the modelling table -------------------------------------
# One row per line item: species = supplier, chemical = part, duration =
# quantity, outcome = extended price (log10 as target).

def observations(spark: SparkSession, sf_dir: str, index: bool = True) -> DataFrame:
    """The modelling table; ``index=False`` skips the row id (one scan, no
    extra shuffle) for plans that only aggregate."""
    li = lineitem_indexed(spark, sf_dir) if index else load(spark, sf_dir, "lineitem")
    obs = li.select(
        *([F.col("idx")] if index else []),
        F.col("l_suppkey").alias("species"),
        F.col("l_partkey").alias("chem"),
        F.col("l_quantity").alias("duration"),
        F.col("l_extendedprice").alias("value"),
        F.log10("l_extendedprice").alias("y"),
    )
    return with_folds(obs)


def with_folds(obs: DataFrame, k: int = K_FOLDS) -> DataFrame:
    """Attach hash folds: setting1 groups pairs, setting2 groups chemicals."""
    pair = [F.col("chem"), F.col("species")]
    chem = [F.col("chem")]
    return obs.select(
        "*",
        int_fold(pair, k).alias("fold1"),
        int_fold(chem, k).alias("fold2"),
        int_fold(pair, k, INNER_SALT).alias("inner1"),
        int_fold(chem, k, INNER_SALT).alias("inner2"),
    )


def _duck_fold(key_cols: list[str], k: int = K_FOLDS, salt: str = "") -> str:
    return int_fold_sql(key_cols, k, salt)


_PAIR_SQL = ["l_partkey", "l_suppkey"]
_CHEM_SQL = ["l_partkey"]

OBS_SQL = (LI_SQL, f"""
obs AS (
  SELECT idx,
         l_suppkey AS species, l_partkey AS chem,
         l_quantity AS duration, l_extendedprice AS value,
         log10(l_extendedprice) AS y,
         {_duck_fold(_PAIR_SQL)} AS fold1,
         {_duck_fold(_CHEM_SQL)} AS fold2,
         {_duck_fold(_PAIR_SQL, salt=INNER_SALT)} AS inner1,
         {_duck_fold(_CHEM_SQL, salt=INNER_SALT)} AS inner2
  FROM li
)""")


# --- raw curation inputs -------------------------------------------------------
# tests ← orders, results ← line items, chemicals ← parts,
# species ← supplier ⋈ nation ⋈ region, references ← customers.

def raw_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    pr = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("test_id"),
        F.col("o_custkey").alias("reference_number"),
        F.when(pr == "5-LOW", "Soil").otherwise("Water").alias("organism_habitat"),
        F.when(F.col("o_orderstatus") == "F", "LAB").when(F.col("o_orderstatus") == "O", "NR")
         .otherwise("FIELD").alias("test_location"),
        F.when(pr == "1-URGENT", "AQUA").when(pr == "2-HIGH", "FD").when(pr == "3-MEDIUM", "S")
         .when(pr == "4-NOT SPECIFIED", F.lit(None)).otherwise("IV").alias("exposure_type"),
    )


RAW_TESTS_SQL = """
tests AS (
  SELECT o_orderkey AS test_id, o_custkey AS reference_number,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'Soil' ELSE 'Water' END AS organism_habitat,
         CASE WHEN o_orderstatus = 'F' THEN 'LAB' WHEN o_orderstatus = 'O' THEN 'NR' ELSE 'FIELD' END AS test_location,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'AQUA' WHEN o_orderpriority = '2-HIGH' THEN 'FD'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'S' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
              ELSE 'IV' END AS exposure_type
  FROM orders
)"""

# Duration units by line number (1..7), concentration units by
# (discount in cents 0..10, line status O/F). The accepted lists and factors
# live in pairgrid.operators.curate.
DURATION_UNIT_BY_LINE = ["h", "d", "mi", "wk", "mo", "hpf", "dpf"]
CONC_UNIT_BY_DISCOUNT_O = ["AI mg/L", "AI ppm", "AI ug/ml", "mg/L", "ppm", "ug/ml", "AI ng/mL",
                           "AI ppb", "AI ug/L", "ng/ml", "pg/ul"]
CONC_UNIT_BY_DISCOUNT_F = ["ppb", "ug/L", "AI ng/L", "ng/L", "pg/ml", "pg/L", "ppt", "g/L",
                           "mg/ml", "ae mg/L", "mM"]


def _pick(index_col, values: list[str]):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index_col)


def raw_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = lineitem_indexed(spark, sf_dir)
    disc = F.round(F.col("l_discount") * 100).cast("int")
    price_txt = F.col("l_extendedprice").cast("decimal(14,2)").cast("string")
    conc_txt = (F.when(F.round(F.col("l_tax") * 100).cast("int") == 0, F.lit("NR"))
                .when((F.col("l_linenumber") == 3) & (F.col("l_returnflag") == "N"), F.concat(price_txt, F.lit("*")))
                .when((disc == 0) & (F.col("l_linestatus") == "O"), F.lit("0"))
                .otherwise(price_txt))
    dur_txt = (F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), F.lit("NR"))
               .otherwise(F.col("l_quantity").cast("decimal(10,1)").cast("string")))
    return li.select(
        F.col("idx").alias("result_id"),
        F.col("l_orderkey").alias("test_id"),
        (F.col("l_partkey") + 50000).alias("test_cas"),
        F.col("l_suppkey").alias("species_number"),
        F.when(F.col("l_returnflag") == "R", "EC50").otherwise("LC50").alias("endpoint"),
        F.when(F.col("l_linestatus") == "O", "MOR").when(F.col("l_linenumber") <= 4, "~MOR/")
         .otherwise("GRO").alias("effect"),
        F.when(F.round(F.col("l_tax") * 100).cast("int") == 8, F.lit(">")).alias("conc1_mean_op"),
        conc_txt.alias("conc1_mean"),
        F.when(F.col("l_linestatus") == "O", _pick(disc + 1, CONC_UNIT_BY_DISCOUNT_O))
         .otherwise(_pick(disc + 1, CONC_UNIT_BY_DISCOUNT_F)).alias("conc1_unit"),
        F.when(F.round(F.col("l_tax") * 100).cast("int") == 7, F.lit("~")).alias("obs_duration_mean_op"),
        dur_txt.alias("obs_duration_mean"),
        _pick(F.col("l_linenumber"), DURATION_UNIT_BY_LINE).alias("obs_duration_unit"),
    )


def _duck_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


RAW_RESULTS_SQL = (LI_SQL, f"""
results AS (
  SELECT idx AS result_id,
         l_orderkey AS test_id,
         l_partkey + 50000 AS test_cas,
         l_suppkey AS species_number,
         CASE WHEN l_returnflag = 'R' THEN 'EC50' ELSE 'LC50' END AS endpoint,
         CASE WHEN l_linestatus = 'O' THEN 'MOR' WHEN l_linenumber <= 4 THEN '~MOR/' ELSE 'GRO' END AS effect,
         CASE WHEN CAST(round(l_tax * 100) AS INTEGER) = 8 THEN '>' END AS conc1_mean_op,
         CASE WHEN CAST(round(l_tax * 100) AS INTEGER) = 0 THEN 'NR'
              WHEN l_linenumber = 3 AND l_returnflag = 'N' THEN CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR) || '*'
              WHEN CAST(round(l_discount * 100) AS INTEGER) = 0 AND l_linestatus = 'O' THEN '0'
              ELSE CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR) END AS conc1_mean,
         CASE WHEN l_linestatus = 'O'
              THEN {_duck_list(CONC_UNIT_BY_DISCOUNT_O)}[CAST(round(l_discount * 100) AS INTEGER) + 1]
              ELSE {_duck_list(CONC_UNIT_BY_DISCOUNT_F)}[CAST(round(l_discount * 100) AS INTEGER) + 1] END AS conc1_unit,
         CASE WHEN CAST(round(l_tax * 100) AS INTEGER) = 7 THEN '~' END AS obs_duration_mean_op,
         CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'NR'
              ELSE CAST(CAST(l_quantity AS DECIMAL(10,1)) AS VARCHAR) END AS obs_duration_mean,
         {_duck_list(DURATION_UNIT_BY_LINE)}[l_linenumber] AS obs_duration_unit
  FROM li
)""")


def raw_chemicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") + 50000).alias("cas_number"),
                    F.col("p_name").alias("chemical_name"),
                    F.concat(F.lit("DTX"), F.col("p_partkey").cast("string")).alias("dtxsid"),
                    F.col("p_type").alias("chem_class"))


RAW_CHEMICALS_SQL = """
chemicals AS (
  SELECT p_partkey + 50000 AS cas_number, p_name AS chemical_name,
         'DTX' || CAST(p_partkey AS VARCHAR) AS dtxsid, p_type AS chem_class
  FROM part
)"""


def raw_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    n = load(spark, sf_dir, "nation")
    r = load(spark, sf_dir, "region")
    # nation and region are fixed-size dimension tables (25 and 5 rows)
    return (s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left")
             .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey, "left")
             .select(F.col("s_suppkey").alias("species_number"),
                     F.col("s_name").alias("latin_name"),
                     F.concat(F.lit("common "), F.col("s_name")).alias("common_name"),
                     F.col("r_name").alias("kingdom"),
                     F.col("n_name").alias("phylum_division")))


RAW_SPECIES_SQL = """
species AS (
  SELECT s_suppkey AS species_number, s_name AS latin_name, 'common ' || s_name AS common_name,
         r_name AS kingdom, n_name AS phylum_division
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
                LEFT JOIN region ON n_regionkey = r_regionkey
)"""


def raw_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("reference_number"),
                    F.col("c_name").alias("author"),
                    F.col("c_mktsegment").alias("title"),
                    F.concat(F.lit("src-"), F.col("c_nationkey").cast("string")).alias("source"),
                    (F.lit(1990) + F.col("c_nationkey")).cast("int").alias("publication_year"))


RAW_REFERENCES_SQL = """
refs AS (
  SELECT c_custkey AS reference_number, c_name AS author, c_mktsegment AS title,
         'src-' || CAST(c_nationkey AS VARCHAR) AS source, CAST(1990 + c_nationkey AS INTEGER) AS publication_year
  FROM customer
)"""


def _flat(ctes):
    for c in ctes:
        if isinstance(c, (tuple, list)):
            yield from _flat(c)
        else:
            yield c.strip()


def with_sql(*ctes, recursive: bool = False) -> str:
    """WITH clause from CTE strings or tuples of them (a CTE with the ones it
    depends on); repeated CTEs are kept once, first position wins."""
    seen = []
    for c in _flat(ctes):
        if c not in seen:
            seen.append(c)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(seen) + "\n"
