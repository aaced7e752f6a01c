"""Design matrices of the linear and factorisation models, in long form.

Blocks (stacking order): species indicators, chemical indicators (setting1
only), duration-bin indicators, the chemical's scaled fingerprint, and the
species × fingerprint interactions (LM5 only). A design is a table
(idx, feature, val); `vectors_from_long` turns it into ML vectors.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgrid.functions.columns import cut_right_closed
from pairgrid.operators.curate import category_code, frequent_edges, log_ratio_scale
from pairgrid.operators.features import hashed_count_fingerprint, interaction_terms, one_hot_long
from pairgrid.plans.roles import load, observations
from pairgrid.sources.writers import scratch_path, write_table

N_BITS = 1024
EDGE_SHARE = 0.02


def chem_text(spark: SparkSession, sf_dir: str, obs: DataFrame) -> DataFrame:
    """Text of every chemical that occurs in the observations."""
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("chem"),
                                          F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    return p.join(obs.select("chem").distinct(), "chem", "left_semi")


def chem_fingerprint(spark: SparkSession, sf_dir: str, obs: DataFrame) -> DataFrame:
    """(chem, bit, cnt): hashed word counts of the chemical's text (F2)."""
    return hashed_count_fingerprint(chem_text(spark, sf_dir, obs), "chem", "text", N_BITS, (1,))


@dataclass
class Coded:
    rows: DataFrame          # idx, y, species, chem, fold1, fold2, sp_code, ch_code, du_code
    fp: DataFrame            # chem, bit, val (scaled)
    n_species: int
    n_chem: int
    n_bins: int
    n_bits: int = N_BITS


def stored_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations that designs are made of, written once: edges, codes and every block read
    them, and the row id's sort is not repeated for each."""
    path = scratch_path(spark, "observations")
    write_table(observations(spark, sf_dir).select("idx", "species", "chem", "duration", "y", "fold1", "fold2", "inner1", "inner2"), path)
    return spark.read.parquet(path)


def coded_observations(spark: SparkSession, sf_dir: str) -> Coded:
    obs = stored_observations(spark, sf_dir)
    edges = frequent_edges(obs, "duration", lo=0.0, min_share=EDGE_SHARE)
    rows = obs.withColumn("du_code", cut_right_closed("duration", edges) - 1)
    rows = category_code(rows, "species", "sp_code")
    rows = category_code(rows, "chem", "ch_code")
    sizes = obs.agg(F.countDistinct("species"), F.countDistinct("chem")).first()
    fp = log_ratio_scale(chem_fingerprint(spark, sf_dir, obs), "bit", "cnt", "val").select("chem", "bit", "val")
    return Coded(rows, fp.checkpoint(eager=True), int(sizes[0]), int(sizes[1]), len(edges) - 1)


def occurring_bits(c: Coded) -> Coded:
    """The same with the fingerprint's bits numbered among those that some chemical has. A column
    without entries has weight 0 in a penalised fit, so models, where the width
    is species x bits, are the same and as wide as what occurs."""
    found = sorted(r["bit"] for r in c.fp.where("val != 0").select("bit").distinct().collect())  # at most N_BITS
    if not found:
        return replace(c, fp=c.fp.where(F.lit(False)), n_bits=0)
    place = F.array_position(F.array(*map(F.lit, found)), F.col("bit")) - 1
    return replace(c, fp=c.fp.where(F.col("bit").isin(found)).withColumn("bit", place.cast("int")), n_bits=len(found))


def blocks(model: str, setting: str) -> list[str]:
    """Feature blocks of a model code under a setting (setting2 drops the chemical block)."""
    base = {"LM3": ["species", "chem", "dur"], "LM4": ["species", "chem", "dur", "fp"],
            "LM5": ["species", "chem", "dur", "fp", "inter"]}[model]
    if setting == "setting2":
        base = [b for b in base if b != "chem"]
    return base


def block_sizes(c: Coded, names: list[str]) -> list[int]:
    size = {"species": c.n_species, "chem": c.n_chem, "dur": c.n_bins, "fp": c.n_bits, "inter": c.n_species * c.n_bits}
    return [size[n] for n in names]


def design_long(c: Coded, names: list[str]) -> tuple[DataFrame, int]:
    """(idx, feature, val) for the listed blocks, and the total width."""
    sizes = block_sizes(c, names)
    offs = {n: sum(sizes[:i]) for i, n in enumerate(names)}
    code_col = {"species": "sp_code", "chem": "ch_code", "dur": "du_code"}
    ind = [n for n in names if n in code_col]
    parts = []
    if ind:
        pieces = [(code_col[n], 0) for n in ind]
        lg = one_hot_long(c.rows.select("idx", *[F.col(code_col[n]) + offs[n] for n in ind]).toDF(
            "idx", *[code_col[n] for n in ind]), "idx", pieces, ind)
        parts.append(lg.select("idx", "feature", "val"))
    if "fp" in names:
        j = c.rows.select("idx", "chem").join(c.fp, "chem")
        parts.append(j.select("idx", (F.col("bit") + offs["fp"]).cast("int").alias("feature"), "val"))
    if "inter" in names:
        parts.append(interaction_terms(c.rows, "idx", "sp_code", "chem", c.fp, c.n_bits, offset=offs["inter"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, sum(sizes)


def design_arrays(c: Coded, names: list[str], keep: list[str], empty: bool = False) -> tuple[DataFrame, int]:
    """The entries of :func:`design_long` gathered by row: ``keep`` columns of the rows, fi
    (features), fv (values), ff (fields: a block's place in ``names``); and the total width.

    A chemical's entries are gathered once and joined to its rows, so no entry of a row is
    exchanged by itself and the rows are read once. Rows without entries are left out but for ``empty``.
    """
    sizes = block_sizes(c, names)
    offs = {n: sum(sizes[:i]) for i, n in enumerate(names)}
    feature = "bigint" if sum(sizes) > 2**31 - 1 or "inter" in names else "int"
    entry = lambda at, val, n: F.struct(at.cast(feature).alias("feature"), val.cast("double").alias("val"), F.lit(names.index(n)).alias("field"))
    none = F.array().cast(f"array<struct<feature:{feature},val:double,field:int>>")
    rows, pieces = c.rows, []
    if {"fp", "inter"} & set(names):
        per_chem = c.fp.groupBy(F.col("chem").alias("_chem")).agg(F.collect_list(F.struct("bit", "val")).alias("_fp"))
        rows = rows.join(per_chem, F.col("chem") == F.col("_chem"), "left")
    for n in names:
        if n == "fp":
            found = F.transform("_fp", lambda e: entry(e["bit"] + offs["fp"], e["val"], "fp"))
        elif n == "inter":
            found = F.when(F.col("sp_code").isNotNull(), F.transform("_fp", lambda e: entry(F.lit(offs["inter"]) + F.col("sp_code").cast("long") * c.n_bits + e["bit"], e["val"], "inter")))
        else:
            code = F.col({"species": "sp_code", "chem": "ch_code", "dur": "du_code"}[n])
            found = F.when(code.isNotNull(), F.array(entry(code + offs[n], F.lit(1.0), n)))
        pieces.append(F.coalesce(found, none))
    rows = rows.select(*keep, F.concat(*pieces).alias("_e"))
    rows = rows if empty else rows.where(F.size("_e") > 0)
    return rows.select(*keep, F.col("_e.feature").alias("fi"), F.col("_e.val").alias("fv"), F.col("_e.field").alias("ff")), sum(sizes)
