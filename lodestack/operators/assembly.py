"""Records from registry, evidence and reasoning; flags; the table and document that leave the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chem as C
from ..functions import text as X
from .metrics import keep_last
from .skew import join_unique

# The columns of the final table, in order, with their names there where they differ.
FINAL_COLUMNS = (
    "paper_id compound_id label_in_paper compound_name_reported compound_formula_reported formula_abbreviation_glossary cation_name_reported cation_abbreviation_reported "
    "cation_formula_explicit cation_formula_status cation_evidence_text cation_source sb_oxidation_state_reported halides_present halides_bonded_to_sb sb_halide_unit_reported "
    "sb_halide_connectivity_evidence_text connectivity_source sb_halide_dimensionality_llm dimensionality_reasoning dimensionality_evidence_status dimensionality_review_reason "
    "synthesis_target_compound synthesis_evidence_text synthesis_source verification_status verification_notes automatic_flags retrieval_cycles_used"
).split()
FINAL_NAMES = {"sb_halide_dimensionality_llm": "sb_halide_dimensionality"}
#: Fields whose text is looked over for odd characters.
FLAG_FIELDS = ["compound_name_reported", "compound_formula_reported", "cation_formula_explicit", "sb_halide_unit_reported"]


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` itself; an error that names the columns it lacks, sorted."""
    if lacking := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def final_table(records: DataFrame, joined: bool = True, keep: list[str] | None = None) -> DataFrame:
    """The final columns under their final names; one that ``records`` lacks is null.
    ``joined``: lists become one string, null elements left out. ``keep`` adds columns."""
    out = [F.col(c) for c in keep or []]
    for c in FINAL_COLUMNS:
        if c not in records.columns:
            x = F.lit(None).cast("string")
        else:
            x = F.col(c)
            if joined and records.schema[c].dataType.typeName() == "array":
                x = X.joined(x)
        out.append(x.alias(FINAL_NAMES.get(c, c)))
    return records.select(*out)


def write_document(df: DataFrame, path: str, order: list[str]) -> None:
    """One JSON array of all rows, sorted by ``order``, as text parts that give the
    document when they are read one after the other. The sort is by ranges, so each
    part is one task's, and no task sees all rows; only the first and the last row
    carry the array's ends, known from one aggregation."""
    key = F.struct(*order)
    # ties of the order are told apart by the row's text
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    rows = df.select(key.alias("k"), line.alias("line"))
    ends = rows.agg(F.min(F.struct("k", "line")).alias("lo"), F.max(F.struct("k", "line")).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not ends["n"]:
        df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    copies = rows.where((F.struct("k", "line") == F.lit(None)) | (F.col("line") == ends["hi"]["line"])).count()
    if copies > 1:  # equal last rows: tell them apart
        rows = rows.withColumn("c", F.monotonically_increasing_id())
    else:
        rows = rows.withColumn("c", F.lit(0))
    last = rows.where(F.col("line") == ends["hi"]["line"]).agg(F.max("c")).first()[0]
    first = rows.where(F.col("line") == ends["lo"]["line"]).agg(F.min("c")).first()[0]
    begin = F.when((F.col("line") == ends["lo"]["line"]) & (F.col("c") == first), "[\n").otherwise("")
    end = F.when((F.col("line") == ends["hi"]["line"]) & (F.col("c") == last), "\n]").otherwise(",")
    rows.orderBy("k", "line", "c").select(F.concat(begin, "line", end).alias("value")).write.mode("overwrite").text(path)


def automatic_flags(name: Column, formula: Column, cations: Column, unit: Column, bonded: Column) -> Column:
    """Messages on a record: lost and odd characters in its four text fields (elements of
    lists with their place), then halides of formula and list that don't agree. Null
    and empty texts have none."""
    none = F.array().cast("array<string>")
    one = lambda label, c: F.when(F.length(c) > 0, X.sanity_flags(F.lit(label), c)).otherwise(none)
    many = F.flatten(F.transform(F.coalesce(cations, none), lambda x, i: F.when(F.length(x) > 0, X.sanity_flags(F.concat(F.lit("cation_formula_explicit["), i.cast("string"), F.lit("]")), x)).otherwise(none)))
    missing, extra = C.halide_flags(formula, bonded)
    shown = F.concat(F.lit("('"), F.coalesce(formula, F.lit("")), F.lit("')"))
    a = F.when(F.size(missing) > 0, F.concat(F.lit("halide(s) "), X.quoted_list(missing), F.lit(" appear in compound_formula_reported "), shown, F.lit(" but are not listed in halides_bonded_to_sb")))
    b = F.when(F.size(extra) > 0, F.concat(F.lit("halides_bonded_to_sb lists "), X.quoted_list(extra), F.lit(", not found in compound_formula_reported "), shown))
    return F.concat(one(FLAG_FIELDS[0], name), one(FLAG_FIELDS[1], formula), many, one(FLAG_FIELDS[3], unit), F.filter(F.array(a, b), lambda x: x.isNotNull()))


def verification_flags(flags: Column, row_sanity: Column, identity: Column, notes: Column) -> Column:
    """``flags`` with what the verifier doubts about the row and the compound's identity."""
    doubt = lambda c: c.isin("fail", "uncertain")
    a = F.when(doubt(row_sanity), F.concat(F.lit("row_sanity check: "), row_sanity, F.lit(": "), F.coalesce(F.nullif(notes, F.lit("")), F.lit("see verification_notes"))))
    b = F.when(doubt(identity), F.concat(F.lit("compound_identity check: "), identity))
    return F.concat(flags, F.filter(F.array(a, b), lambda x: x.isNotNull()))


def assemble_records(compounds: DataFrame, cations: DataFrame, reasoning: DataFrame, dossiers: DataFrame | None = None, glossary: DataFrame | None = None) -> DataFrame:
    """One flat record a compound.

    ``compounds``: paper_id, compound_id, labels_in_paper, compound_name_reported,
    compound_formula_reported; the last row of a compound_id counts (by created_at,
    then row id). ``cations`` and ``reasoning``: the last row of a compound likewise.
    ``dossiers``: paper_id, compound_id, category (cation, connectivity, synthesis),
    evidence_text, source_ids, and an order column n of which the last counts;
    without them, the evidence that the other tables carry. ``glossary``: compound_id
    (once each), symbols, definitions (parallel lists).

    A compound without evidence gets an empty text and no sources; without
    reasoning, label Unknown and status insufficient. A label without sufficient
    evidence is Unknown. A null formula status reads not_reported. Lists without
    value are empty. Compounds without id are dropped; further columns don't count.
    """
    base = keep_last(compounds.where("compound_id is not null").select("compound_id", "paper_id", "labels_in_paper", "compound_name_reported", "compound_formula_reported", "created_at", "registry_row_id"), ["compound_id"], ["created_at", "registry_row_id"]).drop("created_at", "registry_row_id")
    names = ["cation_name_reported", "cation_abbreviation_reported", "cation_formula_explicit", "cation_formula_status"]
    cat = keep_last(cations.select("compound_id", *names, "cation_evidence_text", "cation_source", "created_at", "cation_row_id").where("compound_id is not null"), ["compound_id"], ["created_at", "cation_row_id"]).drop("created_at", "cation_row_id")
    told = "sb_oxidation_state_reported halides_present halides_bonded_to_sb sb_halide_unit_reported sb_halide_connectivity_evidence_text connectivity_source sb_halide_dimensionality_llm dimensionality_reasoning dimensionality_evidence_status dimensionality_review_reason".split()
    dim = keep_last(reasoning.select("compound_id", *told, "created_at", "dim_row_id").where("compound_id is not null"), ["compound_id"], ["created_at", "dim_row_id"]).drop("created_at", "dim_row_id")
    r = join_unique(join_unique(base, cat, "compound_id"), dim, "compound_id")
    none = F.array().cast("array<string>")
    evidence = {"cation": ("cation_evidence_text", "cation_source"), "connectivity": ("sb_halide_connectivity_evidence_text", "connectivity_source"), "synthesis": ("synthesis_evidence_text", "synthesis_source")}
    if dossiers is not None:
        last = keep_last(dossiers.where("compound_id is not null").select("compound_id", "category", "evidence_text", "source_ids", "n"), ["compound_id", "category"], ["n"])
        wide = last.groupBy("compound_id").pivot("category", list(evidence)).agg(F.first(F.struct("evidence_text", "source_ids")))
        r = join_unique(r.drop(*[c for pair in evidence.values() for c in pair]), wide, "compound_id")
        r = r.select("*", *[F.col(k)[f].alias(c) for k, pair in evidence.items() for f, c in zip(("evidence_text", "source_ids"), pair)])
    else:
        r = r.withColumns({"synthesis_evidence_text": F.lit(None).cast("string"), "synthesis_source": F.lit(None).cast("array<string>")})
    if glossary is not None:
        r = join_unique(r, glossary.select("compound_id", X.formatted_pairs(F.col("symbols"), F.col("definitions")).alias("formula_abbreviation_glossary")), "compound_id")
    else:
        r = r.withColumn("formula_abbreviation_glossary", F.lit(None).cast("string"))
    text, many = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c), lambda c: F.coalesce(F.col(c), none).alias(c)
    sure = F.col("dimensionality_evidence_status") == "sufficient"
    return r.select(
        "paper_id", "compound_id", X.joined_labels(F.col("labels_in_paper")).alias("label_in_paper"), "compound_name_reported", "compound_formula_reported", "formula_abbreviation_glossary",
        *[many(c) for c in names[:3]], F.transform(F.coalesce(names[3], none), lambda x: F.coalesce(x, F.lit("not_reported"))).alias(names[3]),
        text("cation_evidence_text"), many("cation_source"), "sb_oxidation_state_reported", many("halides_present"), many("halides_bonded_to_sb"), "sb_halide_unit_reported",
        text("sb_halide_connectivity_evidence_text"), many("connectivity_source"),
        F.coalesce(F.when(sure, F.col("sb_halide_dimensionality_llm")), F.lit("Unknown")).alias("sb_halide_dimensionality_llm"), "dimensionality_reasoning",
        F.coalesce("dimensionality_evidence_status", F.lit("insufficient")).alias("dimensionality_evidence_status"), "dimensionality_review_reason",
        F.coalesce(F.nullif("compound_name_reported", F.lit("")), "compound_id").alias("synthesis_target_compound"), text("synthesis_evidence_text"), many("synthesis_source"),
    )


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two tables in which each key occurs once; an error if one occurs more often."""
    for side in (a, b):
        twice = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys).first()
        if twice:
            raise ValueError(f"key occurs more than once: {tuple(twice)}")
    return a.join(b, keys)


#: What stands before the query in a prompt.
MARKER = "\n\nCompound to classify:\n"


def example_prompt(instruction: Column, shots: Column, block: Column) -> Column:
    """Instruction, labelled examples (null: none) and the query, with the answer left open."""
    examples = F.coalesce(F.concat(F.lit("\n\nLabeled examples:\n"), shots), F.lit(""))
    return F.concat(instruction, examples, F.lit(MARKER), block, F.lit("\nAnswer:"))


def ranking_prompt(order: Column, features: dict[str, tuple[str, str]], prefix: str, suffix: str, condition: Column, data: Column) -> tuple[Column, Column]:
    """(prompt, error): the definitions of the features in ``order`` between prefix and
    suffix. Errors, with a null prompt: an order that is no permutation, a condition
    that is none, data without or with the wrong condition."""
    blocks = F.create_map(*[F.lit(x) for k, (name, text) in features.items() for x in (k, f"{k}. {name}\nDefinition: {text}")])
    want = F.array(*[F.lit(k) for k in sorted(features)])
    error = (
        F.when(order.isNull() | (F.array_sort(order) != want), "no permutation")
        .when(~F.coalesce(condition.isin("no_data", "with_data"), F.lit(False)), "unknown condition")
        .when((condition == "no_data") & data.isNotNull(), "data block without condition")
        .when((condition == "with_data") & (F.coalesce(data, F.lit("")) == ""), "no data block")
    )
    body = F.concat(F.lit(prefix), F.coalesce(F.concat(data, F.lit("\n\n")), F.lit("")), F.array_join(F.transform(order, lambda x: F.try_element_at(blocks, x)), "\n\n"), F.lit(suffix))
    return F.when(error.isNull(), body), error
