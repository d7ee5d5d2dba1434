"""Chemistry expressions on formulas and SMILES strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALIDES = ["F", "Cl", "Br", "I"]
# Fixed value: an element with its count.
_PART = "([A-Z][a-z]?)([0-9]*\\.?[0-9]*)"


def bare_formula(c: Column) -> Column:
    """Formula without blanks and brackets; group subscripts are not multiplied."""
    return F.regexp_replace(c, r"[\s\[\]()]", "")


def formula_counts(c: Column) -> Column:
    """array<struct<element,count>> of a formula in order, or null for one with a
    variable, a charge between digits, or anything that is no element with count."""
    bare = bare_formula(c)
    el, n = F.regexp_extract_all(bare, F.lit(_PART), 1), F.regexp_extract_all(bare, F.lit(_PART), 2)
    again = F.array_join(F.regexp_extract_all(bare, F.lit(f"({_PART})"), 1), "")
    ok = (F.length(bare) > 0) & ~F.lower(bare).contains("x") & ~bare.rlike("[0-9][+-][0-9]") & (again == bare)
    parts = F.transform(F.arrays_zip(el.alias("e"), n.alias("n")), lambda p: F.struct(p["e"].alias("element"), F.when(p["n"].isin("", "."), 1.0).otherwise(p["n"].cast("double")).alias("count")))
    return F.when(ok, parts)


def halides_in(c: Column) -> Column:
    """Halide symbols that occur in a formula as substrings (In counts as I, Fe as F)."""
    return F.filter(F.array(*[F.lit(h) for h in HALIDES]), lambda h: c.contains(h))


def halide_flags(formula: Column, bonded: Column) -> tuple[Column, Column]:
    """(halides of the formula that are not listed as bonded, listed ones that the
    formula lacks), both sorted. A null formula is empty, a null list too; null
    elements are none; what is listed counts whether it is a halide or not."""
    f = halides_in(F.coalesce(formula, F.lit("")))
    b = F.array_compact(F.coalesce(bonded, F.array().cast("array<string>")))
    return F.array_sort(F.array_except(f, b)), F.array_sort(F.array_except(b, f))


def inorganic_composition(df: DataFrame, total: str, organic: str, listed: str) -> DataFrame:
    """Add f_F, f_Cl, f_Br, f_I, x_to_m, mixed and error of the inorganic part.

    ``total`` and ``organic`` are columns of formula_counts (total null: variable
    formula); ``listed`` the halides on the metal. One listed halide: its share is 1,
    and the ratio to Sb + Bi counts what the cations leave of it. Several: shares of
    what the cations leave of each. Errors: unsupported_halide, variable_formula,
    no_inorganic_halide, unexplained_halide; an error leaves all else null.
    """
    # one map each, looked up by element, and every step a column, so that no expression is worked out twice
    as_map = lambda c: F.aggregate(F.col(c), F.create_map().cast("map<string,double>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["element"]), F.create_map(x["element"], F.coalesce(F.try_element_at(m, x["element"]), F.lit(0.0)) + x["count"])))
    df = df.withColumn("__t", as_map(total)).withColumn("__o", as_map(organic))
    n = lambda side, e: F.coalesce(F.try_element_at(F.col(side), F.lit(e)), F.lit(0.0))
    df = df.select("*", *[n(side, e).alias(f"{side}{e}") for side in ("__t", "__o") for e in ("C", "N", "S", "P", *HALIDES)], F.nullif(n("__t", "Sb") + n("__t", "Bi"), F.lit(0.0)).alias("__metal"), (F.size(listed) > 1).alias("__mixed"))
    ratios = F.filter(F.array(*[F.when((F.col(f"__o{e}") > 0) & (F.col(f"__t{e}") > 0), F.col(f"__t{e}") / F.col(f"__o{e}")) for e in ("C", "N", "S", "P")]), lambda x: x.isNotNull())
    df = df.withColumn("__ratios", ratios).withColumn("__m", multiplier(F.col("__ratios")))
    has = lambda h: F.array_contains(listed, h)
    df = df.select("*", *[(F.col(f"__t{h}") - F.col("__m") * F.col(f"__o{h}")).alias(f"__r{h}") for h in HALIDES])
    df = df.select("*", *[F.when(has(h), F.greatest(f"__r{h}", F.lit(0.0))).otherwise(0.0).alias(f"__i{h}") for h in HALIDES])
    df = df.withColumn("__all", sum((F.col(f"__i{h}") for h in HALIDES), F.lit(0.0)))
    stray = F.lit(False)
    for h in HALIDES:
        stray = stray | (~has(h) & (F.col(f"__r{h}") > 0.08))
    mixed = F.col("__mixed")
    error = (
        F.when(F.size(F.array_except(listed, F.array(*[F.lit(h) for h in HALIDES]))) > 0, "unsupported_halide")
        .when(mixed & F.col(total).isNull(), "variable_formula")
        .when(mixed & (F.col("__all") <= 0), "no_inorganic_halide")
        .when(mixed & stray, "unexplained_halide")
    )
    df = df.withColumn("error", error)
    ok = F.col("error").isNull()
    share = [F.when(ok, F.when(mixed, F.col(f"__i{h}") / F.nullif("__all", F.lit(0.0))).otherwise(has(h).cast("double"))).alias(f"f_{h}") for h in HALIDES]
    out = df.select("*", *share, F.when(ok & (F.col("__all") > 0), F.col("__all") / F.col("__metal")).alias("x_to_m"), F.when(ok, mixed).alias("mixed"))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def heavy_atoms(c: Column) -> Column:
    """Atoms of a SMILES string as written: bracket atoms, two-letter and one-letter organic ones."""
    return F.regexp_extract_all(c, F.lit(r"(\[[^\]]+\]|Cl|Br|[BCNOPSFI]|[bcnops])"), 1)


def atom_counts(c: Column) -> Column:
    """array<struct<element,count>> of the heavy atoms of a SMILES string, sorted by
    element; null for one with unbalanced brackets or a mark that no SMILES has."""
    names = F.transform(heavy_atoms(c), lambda a: F.when(a.startswith("["), F.regexp_extract(a, r"^\[\d*([A-Z][a-z]?|[bcnops])", 1)).otherwise(a))
    names = F.transform(names, F.initcap)
    names = F.filter(names, lambda a: a != "H")
    opens = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    ok = (F.length(c) > 0) & (opens("(") == opens(")")) & (opens("[") == opens("]")) & ~c.rlike(r"[^A-Za-z0-9@+\-\[\]()=#$:/\\.%*]")
    counts = F.transform(F.array_sort(F.array_distinct(names)), lambda e: F.struct(e.alias("element"), F.size(F.filter(names, lambda x: x == e)).cast("double").alias("count")))
    return F.when(ok, counts)


def multiplier(ratios: Column) -> Column:
    """Median of the ratios that are near an integer, rounded; else of the ratios; 1 for none."""
    near = F.transform(F.filter(ratios, lambda r: F.abs(r - F.bround(r, 0)) < 0.08), lambda r: F.bround(r, 0))
    return F.when(F.size(ratios) == 0, 1.0).when(F.size(near) > 0, _median(near)).otherwise(_median(ratios))


def _median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
