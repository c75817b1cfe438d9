"""Dictionary enrichment: keyword classes, keywords, expansion, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words by which a passage's content type is told.
CONTENT_TYPES = {
    "anatomy": ("structure", "anatomy", "location", "origin", "insertion", "nerve supply", "blood supply", "lymphatic drainage", "gross", "histology", "tissue", "organ", "system"),
    "physiology": ("function", "physiology", "mechanism", "process", "regulation", "metabolism", "secretion", "absorption", "excretion", "transport", "homeostasis", "normal"),
    "pathology": ("disease", "pathology", "disorder", "abnormal", "injury", "tumor", "cancer", "malignant", "benign", "inflammation", "infection", "degeneration", "lesion"),
    "pharmacology": ("drug", "medication", "therapy", "treatment", "pharmacological", "dose", "administration", "contraindication", "side effect", "adverse", "interaction"),
    "clinical": ("symptom", "sign", "diagnosis", "clinical", "presentation", "examination", "patient", "case", "management", "prognosis"),
}
# Words by which a passage's body system is told.
SYSTEMS = {
    "cardiovascular": ("heart", "cardiac", "vascular", "blood vessel", "artery", "vein", "circulation", "coronary", "myocardial", "perfusion"),
    "nervous": ("brain", "nerve", "neural", "spinal cord", "cerebral", "neuron", "synapse", "cortex", "neurological", " CNS ", "central nervous system"),
    "respiratory": ("lung", "pulmonary", "respiration", "breath", "airway", "alveolar", "ventilation", "oxygenation", "trachea", "bronch"),
    "gastrointestinal": ("stomach", "intestine", "bowel", "digestion", "gastro", "intestinal", "colon", "gastric", "hepatic", "liver", "pancreas"),
    "renal": ("kidney", "renal", "nephron", "urine", "urinary", "glomerular", "filtration", "dialysis"),
    "endocrine": ("hormone", "endocrine", "thyroid", "insulin", "pituitary", "adrenal", "metabolism", "glucose"),
    "musculoskeletal": ("muscle", "bone", "skeletal", "joint", "cartilage", "tendon", "ligament", "fracture", "orthopedic"),
    "immune": ("immune", "lymphocyte", "antibody", "antigen", "inflammation", "infection", "vaccine", "immunity", "lymph"),
    "hematologic": ("blood", "hemoglobin", "erythrocyte", "leukocyte", "platelet", "anemia", "coagulation", "clotting", "hematology"),
    "reproductive": ("reproductive", "fertility", "pregnancy", "uterus", "ovary", "testis", "prostate", "gonad", "embryo", "fetus"),
}
# Capitalised words that are no keywords.
COMMON = "The This That These Those A An And Or But Is Are Was Were Be Been Being Have Has Had Do Does Did Will Would Could Should May Might Must Can Of In On At To For From With By As".split()


def classify(text: Column, classes: dict[str, tuple[str, ...]], default: str | None) -> Column:
    """The class with most words inside the text (as substrings), the first of equals; the default without any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scores = [F.struct(sum((low.contains(w).cast("int") for w in ws), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, (c, ws) in enumerate(classes.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["c"]).otherwise(F.lit(default))


def keywords(docs: DataFrame, key: str, text: Column, k: int = 10) -> DataFrame:
    """key, keywords: capitalised words of more than three letters by frequency, then first place."""
    words = docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1)).alias("pos", "word"))
    words = words.filter(F.col("word").rlike("^[A-Z][a-z]+$") & (F.length("word") > 3) & ~F.col("word").isin(*COMMON))
    ranked = words.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))).filter(F.col("rank") <= k)
    return ranked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), ",").alias("keywords"))


def canonical(c: Column, names: list[str], aliases: dict[str, str]) -> Column:
    """The known name of a reply: its first line without a leading label, by exact match or alias, any case."""
    bare = F.trim(F.element_at(F.split(F.trim(F.regexp_replace(F.trim(c), r"(?i)^subject:", "")), "\n"), 1))
    table = {n.lower(): n for n in names} | {a.lower(): n for a, n in aliases.items()}
    flat = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*flat), F.lower(bare)), F.lit("Unknown"))


def expand(text: Column, synonyms: dict[str, list[str]], cap: int = 30) -> Column:
    """Synonyms of the words and word pairs of a text: those with a space first, then by length and text."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " "), " +"), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    flat = [x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    table = F.create_map(*flat)
    found = F.flatten(F.transform(F.filter(F.concat(words, pairs), lambda w: F.map_contains_key(table, w)), lambda w: F.element_at(table, w)))
    ordered = F.array_sort(F.transform(F.array_distinct(found), lambda x: F.struct((~x.contains(" ")).cast("int").alias("a"), F.length(x).alias("b"), x.alias("x"))))
    return F.slice(F.transform(ordered, lambda s: s["x"]), 1, cap)


def same_domain(predicted: Column, actual: Column, names: list[str], aliases: dict[str, str]) -> Column:
    """Whether two replies name one domain, aliases on either side told; unknown names compare as they stand."""
    plain = lambda c: F.lower(F.trim(c))
    known = lambda c: F.lower(canonical(c, names, aliases))
    either = lambda c: F.when(known(c) == "unknown", plain(c)).otherwise(known(c))
    return F.coalesce(either(predicted) == either(actual), F.lit(False))


def with_metadata(chunks: DataFrame, text: str, **standard: Column) -> DataFrame:
    """``metadata``: content type, body system (null without any) and the given fields."""
    kind, system = classify(F.col(text), CONTENT_TYPES, "general"), classify(F.col(text), SYSTEMS, None)
    return chunks.withColumn("metadata", F.struct(kind.alias("content_type"), system.alias("system"), *[c.alias(n) for n, c in standard.items()]))


def metadata_report(chunks: DataFrame) -> DataFrame:
    """field, value, n: how often each content type and system occurs, and how many chunks have all fields."""
    names = chunks.schema["metadata"].dataType.names
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(f"metadata.{n}").isNotNull()
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in (("content_type", F.col("metadata.content_type")), ("system", F.coalesce("metadata.system", F.lit("none"))), ("complete", whole.cast("string")))])
    return chunks.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))
