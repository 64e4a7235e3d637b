"""Licence scans: a trained paragraph classifier with a calibrated unknown class, confirmed by template comparison.

Only DataFrame functions and Spark ML are used. Sparse logistic regression over word unigrams and bigrams learns the
families from names in sentences and from passages of the licences (``licence_texts``), also amid words of the corpus;
what names no licence from a bounded sample of the corpus; and the unknown class from notices with other names, some
made of the corpus' words. A part of the phrasings is held out: from it come each family's least probability and recall.
The scan first sums, for each paragraph, what its n-grams can give any class over ``none``: an upper bound, so that
paragraphs that can't reach a class are left out exactly and only the others are scored in full. Templates, which are
other phrases than the training sentences, confirm a family.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.licence_texts import FRAMES, NAMES, OTHERS, PASSAGES, PROSE, TEMPLATES

NONE, UNKNOWN = "none", "unknown"
#: Words with which a line begins a notice, so a new paragraph.
OPENERS = "Licen[sc]e(?=:)|Licensed|Released|Distributed|Published|This|Permission|Redistributions?|Copyright|SPDX|All"
#: Corpus paragraphs with such words teach nothing: they may name a licence.
CUES = r"(?i)licen[sc]|copyright|spdx|rights reserved|warrant|public domain|creative commons|\bcc[ -]by|cc0"
SCHEMA = "doc_id long, paragraph int, family string, probability double, template_share double"


@dataclass(frozen=True)
class Scan:
    """About ``documents`` distinct texts, chosen by hash, are the sample without licences; ``vocabulary`` bounds the n-grams of the classifier."""

    documents: int = 2000
    vocabulary: int = 4096
    penalty: float = 0.0002
    iterations: int = 30
    least_weight: float = 0.01
    #: The share of a family's held-out phrasings that its least probability may call unknown.
    miss: float = 0.05
    #: Bounds of the least probability.
    floor: float = 0.5
    ceiling: float = 0.9
    #: The share of a template's words, and of its word pairs, that confirms a family.
    confirm: float = 0.8


@dataclass(frozen=True)
class Model:
    """Classes, their intercepts and least probabilities, weights of each n-gram, and the recall of held-out phrasings."""

    classes: list[str]
    base: list[float]
    least: list[float]
    weights: dict[str, list[float]]
    recall: dict[str, float]

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("class", c, [b, t, self.recall.get(c, -1.0)]) for c, b, t in zip(self.classes, self.base, self.least, strict=True)]
        rows += [("gram", g, [float(x) for x in w]) for g, w in self.weights.items()]
        spark.createDataFrame(rows, "kind string, name string, numbers array<double>").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        rows = spark.read.parquet(path).orderBy("kind", "name").collect()
        kept = [(r.name, r.numbers) for r in rows if r.kind == "class"]
        weights = {r.name: r.numbers for r in rows if r.kind == "gram"}
        return Model([c for c, _ in kept], [x[0] for _, x in kept], [x[1] for _, x in kept], weights, {c: x[2] for c, x in kept if x[2] >= 0})


def _words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"[\s\p{Punct}]+"), lambda w: w != "")


def _grams(words: str) -> Column:
    pairs = F.expr(f"if(size({words}) < 2, array(), zip_with(slice({words}, 1, size({words}) - 1), slice({words}, 2, size({words}) - 1), (a, b) -> concat(a, ' ', b)))")
    return F.array_distinct(F.concat(F.col(words), pairs))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(family, text.split()) for family, texts in TEMPLATES.items() for text in texts]
    return spark.createDataFrame(rows, "family string, template array<string>")


def _held(template: str, words: str) -> Column:
    """The share of a template's words and word pairs that a paragraph holds."""
    return F.size(F.array_intersect(_grams(template), _grams(words))) / F.size(_grams(template))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, paragraph, line): paragraphs of each text that aren't blank, by the number of their first line.

    A line begins a paragraph if it or the one before is blank, the one before ends a sentence, or its first word opens a
    notice (``OPENERS``); other lines are wrapped ones. ``copy`` tells texts of one doc_id apart.
    """
    lines = docs.where("text is not null").select("doc_id", F.md5("text").alias("copy"), F.split("text", r"\r?\n", -1).alias("lines"))
    begins = F.expr(
        rf"filter(transform(lines, (x, i) -> if(i = 0 or trim(x) = '' or rlike(lines[i - 1], '^\\s*$|[.!?:;]\\W*$') "
        rf"or rlike(x, '^\\W*(?:{OPENERS})\\b'), i, -1)), i -> i >= 0)"
    )
    lines = lines.withColumn("begins", begins)
    parts = F.expr("transform(begins, (b, j) -> struct(b as paragraph, array_join(slice(lines, b + 1, coalesce(get(begins, j + 1), size(lines)) - b), '\n') as line))")
    return lines.select("doc_id", "copy", F.explode(parts).alias("part")).select("doc_id", "copy", "part.*").where(F.trim("line") != "")


def _phrases() -> list[tuple[str, str]]:
    """(label, text): names in sentences, passages, other licences and prose; a fixed number."""
    rows = [(family, frame.format(name)) for family, names in NAMES.items() for name in names for frame in FRAMES]
    rows += [(UNKNOWN, frame.format(name)) for name in OTHERS for frame in FRAMES]
    rows += [(family, text) for family, texts in PASSAGES.items() for text in texts]
    return rows + [(NONE, text) for text in PROSE]


def labelled(docs: DataFrame, p: Scan = Scan()) -> DataFrame:
    """(words, label, fixed, test): the phrases, whole, with a word left out and amid words of the corpus, and a bounded sample of ``docs``.

    The sample is of distinct texts, so repeated rows don't move it. ``test`` holds out whole phrasings.
    """
    spark = docs.sparkSession
    texts = docs.where("text is not null").select("text")
    seen = texts.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0]
    share = min(1.0, p.documents / max(1, seen))
    sample = texts.where(F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1)) < int(share * (1 << 31))).withColumn("doc_id", F.lit(0))
    plain = paragraphs(sample).where(~F.col("line").rlike(CUES)).select(_words(F.col("line")).alias("words")).where(F.size("words") > 0).distinct()
    plain = plain.withColumn("hash", F.xxhash64("words"))
    near = plain.groupBy(F.pmod("hash", F.lit(64)).cast("int").alias("key")).agg(F.min_by(F.slice("words", 1, 40), "hash").alias("near"))
    made = spark.createDataFrame([(k, label, text) for k, (label, text) in enumerate(_phrases())], "k int, label string, text string")
    made = made.select("k", "label", _words(F.col("text")).alias("words"), (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("test"), F.pmod("k", F.lit(64)).alias("key"))
    amid = made.join(F.broadcast(near), "key")
    longer = amid.select("label", F.when(F.pmod("k", F.lit(2)) == 0, F.concat("words", "near")).otherwise(F.concat("near", "words")).alias("words"), "test")
    shorter = made.where((F.size("words") > 4) & ~F.col("label").isin(NONE, UNKNOWN)).select("label", F.filter("words", lambda w, i: i != F.pmod(F.col("k"), F.size("words"))).alias("words"), "test")
    frames = F.array(*[F.lit(f) for f in FRAMES])
    name = F.concat_ws(" ", F.slice("near", 1, 2), F.array(F.lit("license")))
    other = near.select(F.lit(UNKNOWN).alias("label"), _words(F.replace(F.element_at(frames, F.pmod("key", F.lit(len(FRAMES))) + 1), F.lit("{}"), name)).alias("words"), F.lit(False).alias("test"))
    fixed = made.select("label", "words", "test").withColumn("fixed", F.lit(True))
    rest = longer.unionByName(shorter).unionByName(other).unionByName(plain.select(F.lit(NONE).alias("label"), "words", (F.pmod("hash", F.lit(5)) == 0).alias("test")))
    return fixed.unionByName(rest.withColumn("fixed", F.lit(False)))


def fit(docs: DataFrame, p: Scan = Scan()) -> Model:
    """The classifier; no class counts for more by having more rows; ``none`` counts for half, a half of it fixed prose, ``unknown`` for a tenth."""
    # the sample is bounded, and every iteration of the fit costs a task per partition
    rows = labelled(docs, p).withColumn("grams", _grams("words")).repartition(4).cache()
    vectors = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=p.vocabulary, minDF=2.0, binary=True).fit(rows.where("fixed"))
    names = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(rows.where("fixed"))
    classes = list(names.labels)
    kind = F.when(F.col("fixed") & (F.col("label") == NONE), F.lit("prose")).otherwise(F.col("label"))
    counts = {r.kind: r.n for r in rows.where("not test").groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).collect()}
    part = {NONE: 0.25, "prose": 0.25, UNKNOWN: 0.1}
    weight = F.coalesce(*[F.when(kind == c, part.get(c, 0.4 / (len(classes) - 2)) * 1000 / n) for c, n in sorted(counts.items())], F.lit(0.0))
    ready = names.transform(vectors.transform(rows)).withColumn("weight", weight)
    model = LogisticRegression(labelCol="y", weightCol="weight", family="multinomial", elasticNetParam=1.0, regParam=p.penalty, maxIter=p.iterations).fit(ready.where("not test"))
    matrix = model.coefficientMatrix.toArray()
    weights = {g: matrix[:, k].tolist() for k, g in enumerate(vectors.vocabulary) if abs(matrix[:, k]).max() >= p.least_weight}
    own = F.element_at(vector_to_array("probability"), F.col("y").cast("int") + 1).alias("own")
    held = model.transform(ready.where("test")).select("label", own, (F.col("prediction") == F.col("y")).alias("right"))
    found = held.groupBy("label").agg(F.percentile("own", F.lit(p.miss)).alias("least"), F.avg(F.col("right").cast("double")).alias("recall")).collect()
    rows.unpersist()
    least = {r.label: min(max(r.least, p.floor), p.ceiling) for r in found}
    return Model(classes, model.interceptVector.toArray().tolist(), [least.get(c, p.floor) for c in classes], weights, {r.label: r.recall for r in found})


def _scored(lines: DataFrame, model: Model) -> DataFrame:
    """Paragraphs that may be of a class other than ``none``, with each class's sum as z0, z1, ..."""
    spark, none = lines.sparkSession, model.classes.index(NONE)
    gain = [(g, float(max(0.0, *(x - w[none] for x in w)))) for g, w in model.weights.items()]
    head = max(b - model.base[none] for k, b in enumerate(model.base) if k != none)
    gains = spark.createDataFrame([r for r in gain if r[1] > 0] or [("", 0.0)], "gram string, gain double")
    key = ["doc_id", "copy", "paragraph", "line"]
    # equal rows add to the bound, which stays one, and become one row here
    bound = lines.withColumn("words", _words(F.col("line"))).select(*key, F.explode(_grams("words")).alias("gram"))
    bound = bound.join(F.broadcast(gains), "gram").groupBy(*key).agg(F.sum("gain").alias("bound")).where(F.col("bound") + head >= -1e-9).drop("bound")
    columns = [f"w{k}" for k in range(len(model.classes))]
    table = spark.createDataFrame([(g, *w) for g, w in model.weights.items()] or [("", *[0.0] * len(columns))], ", ".join(["gram string", *(f"{c} double" for c in columns)]))
    full = bound.withColumn("words", _words(F.col("line"))).select(*key, F.explode(_grams("words")).alias("gram"))
    return full.join(F.broadcast(table), "gram").groupBy(*key).agg(*[(F.sum(c) + model.base[k]).alias(f"z{k}") for k, c in enumerate(columns)])


def scan(docs: DataFrame, p: Scan = Scan(), model: Model | None = None) -> DataFrame:
    """(doc_id, paragraph, family, probability, template_share) of each paragraph of ``docs`` that names a licence.

    ``paragraph`` is the number of its first line in its text. A paragraph whose likeliest class is ``none`` gives no row;
    one of the unknown class, or whose family is less probable than the family's least, or isn't confirmed by a template,
    is ``unknown``. Ties between classes go to the first by name. Without ``model`` one is fitted on ``docs``. Null and blank
    texts give no rows; repeated rows give their paragraphs once; a null doc_id is carried along; other columns are not
    looked at; no rows give no rows.
    """
    spark = docs.sparkSession
    if docs.limit(1).isEmpty():
        return spark.createDataFrame([], SCHEMA)
    model = model or fit(docs, p)
    zs = [F.col(f"z{k}") for k in range(len(model.classes))]
    found = _scored(paragraphs(docs), model).withColumn("top", F.greatest(*zs))
    total = sum((F.exp(z - F.col("top")) for z in zs), F.lit(0.0))
    best = F.coalesce(*[F.when(z == F.col("top"), F.struct(F.lit(c).alias("likely"), F.lit(t).alias("least"))) for z, c, t in zip(zs, model.classes, model.least, strict=True)])
    found = found.select("doc_id", "copy", "paragraph", _words(F.col("line")).alias("words"), (1 / total).alias("probability"), best.alias("best"))
    found = found.select("*", "best.likely", "best.least").where(F.col("likely") != NONE)
    shares = found.join(F.broadcast(_templates(spark)), F.col("likely") == F.col("family"), "left").withColumn("share", F.coalesce(_held("template", "words"), F.lit(0.0)))
    shares = shares.groupBy("doc_id", "copy", "paragraph", "likely", "least", "probability").agg(F.max("share").alias("template_share"))
    sure = (F.col("probability") >= F.col("least")) & (F.col("template_share") >= p.confirm)
    return shares.select(F.col("doc_id").cast("long").alias("doc_id"), "paragraph", F.when(sure, F.col("likely")).otherwise(F.lit(UNKNOWN)).alias("family"), "probability", "template_share")
