"""Language ID by Bayesian evidence fusion.

Evidence of one document (or page):
  text      log likelihood of its byte trigrams under each language's trigram model, tempered;
  declared  the language that the markup (or the table's ``lang``) declares: P(declared | language), with the
            confusion counts taken by grouped aggregation over all documents;
  host      prior P(language | host), smoothed towards the host's address suffix, and that towards the corpus: each
            level's counts, again by grouped aggregation over all documents, plus KAPPA pseudo-counts of the level above.
The extra class ``und`` (no language) spreads letters evenly.  The posterior is their normalised product; a document is
rejected if ``und`` wins, that is, if its text looks less like any known language than like letters drawn at random.

Every declared language has a trigram model.  The models are fitted on a sample of labelled rows, chosen by hash of the id:
about SAMPLE_ROWS as they come, and of rare languages an equal share of as many again, LEAST_ROWS at least; everything else
covers all rows.  The DENSE commonest languages are columns of a table, the others lists of the trigrams they hold, so that
the models grow with the sampled text.  A model is sound if it explains its own sampled rows, each trigram left out once,
better than ``und`` does; ``und`` can't reject a document whose declared language has no sound model.  Counts shuffle after partial aggregation; a host with a third of all rows is one row a task, and its
join back is one that Spark can split.

Defined results.  Null or empty text, or text without letters: the likelihoods are equal, so the other evidence decides;
with none of those either, the prior.  Null language, host or address: no such evidence.  Null doc_id: kept, judged by
the same rules.  Repeated rows are judged alike.  An empty table gives an empty table.  Other columns are carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import semi, state
from . import textblocks as tb

SAMPLE_ROWS = 8000
LEAST_ROWS = 16
DENSE = 64
TEMPER, KAPPA, ALPHA, UND_PRIOR = 0.25, 20.0, 0.5, 1e-6
NO_LANGUAGE = "und"

#: Byte classes: 0 for what separates, 1-26 letters, then the bytes of non-ASCII characters.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27 + (np.arange(128, 256) & 0x3F)
_N = 27 + 64


def _trigrams(block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of a block whose middle byte is a letter, and their row."""
    n = len(block.buf)
    code = _CLASS[tb.LOWER[block.buf]]
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n:
        left[1:], right[:-1] = code[:-1], code[1:]
        inner = block.offs[1:-1]
        left[inner[inner < n]] = 0
        right[inner[(inner > 0)] - 1] = 0
    at = np.flatnonzero(code > 0)
    return (left[at] * _N + code[at]) * _N + right[at], np.searchsorted(block.offs, at, side="right") - 1


@dataclass
class Model:
    """log P(trigram | language): a float32 table for the commonest languages, for the others only the trigrams they hold."""

    dense: list[int]  # languages of the table's columns
    table: np.ndarray
    sparse: list[int]  # the other languages
    starts: np.ndarray  # by trigram (CSR)
    column: np.ndarray  # place in sparse
    gain: np.ndarray  # over the language's base
    base: np.ndarray  # of a trigram that the language doesn't hold

    def scores(self, gram: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Log likelihoods by row (grams cut[r] .. cut[r+1]-1) and language."""
        rows = len(cut) - 1
        out = np.zeros((rows, len(self.dense) + len(self.sparse)))
        total = np.zeros((len(gram) + 1, len(self.dense)))
        total[1:] = np.cumsum(self.table[gram], axis=0, dtype=np.float64)
        out[:, self.dense] = total[cut[1:]] - total[cut[:-1]]
        if self.sparse:
            n = self.starts[gram + 1] - self.starts[gram]
            at = np.repeat(self.starts[gram] - np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64), n) + np.arange(int(n.sum()))
            row = np.repeat(np.repeat(np.arange(rows), np.diff(cut)), n)
            gain = np.bincount(row * len(self.sparse) + self.column[at], weights=self.gain[at], minlength=rows * len(self.sparse))
            out[:, self.sparse] = gain.reshape(rows, -1) + np.diff(cut)[:, None] * self.base
        return out


def _model(lang: np.ndarray, gram: np.ndarray, n: np.ndarray, common: list[int]) -> tuple[Model, np.ndarray]:
    """Model of counted trigrams; ``common``: languages, the commonest first.  Also which languages' models are sound."""
    k, a = len(common), ALPHA / 10
    held = np.bincount(lang, weights=n, minlength=k)
    base = np.log(a / (held + a * _N**3))
    once_less = np.log((n - 1 + a) / (held[lang] - 1 + a * _N**3))
    sound = np.bincount(lang, weights=n * once_less, minlength=k) > _UND * held
    dense, sparse = sorted(common[:DENSE]), sorted(common[DENSE:])
    place = np.zeros(k, np.int64)
    place[dense], place[sparse] = np.arange(len(dense)), np.arange(len(sparse))
    inside = np.isin(lang, dense)
    table = np.tile(base[dense].astype(np.float32), (_N**3, 1))
    table[gram[inside], place[lang[inside]]] = np.log((n[inside] + a) / (held[lang[inside]] + a * _N**3))
    lang, gram, n = lang[~inside], gram[~inside], n[~inside]
    order = np.argsort(gram, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(gram, minlength=_N**3)))) if sparse else np.zeros(0, np.int64)
    return Model(dense, table, sparse, starts, place[lang[order]], np.log((n[order] + a) / a), base[sparse]), sound


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], Model | None, list[str]]:
    """All declared languages, their model, and those whose model is sound."""
    spark = docs.sparkSession
    labelled = docs.where("declared is not null and declared != ''")
    counts = labelled.groupBy("declared").count().orderBy(F.desc("count"), "declared").collect()
    if not counts:
        return [], None, []
    names = sorted(r["declared"] for r in counts)
    index = {x: i for i, x in enumerate(names)}
    least = max(LEAST_ROWS, sample_rows // len(names))
    share = sample_rows / sum(r["count"] for r in counts)
    limits = [(r["declared"], index[r["declared"]], int(min(1.0, max(share, least / r["count"])) * (1 << 30))) for r in counts]
    limits = spark.createDataFrame(limits, "l_ string, lang int, below long")
    sample = labelled.join(F.broadcast(limits), F.col("declared") == F.col("l_")).where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("below")).select("lang", "text")

    def count(batches):
        for batch in batches:
            label = batch.column(0).to_numpy()
            for block in tb.blocks(batch.column(1)):
                gram, row = _trigrams(block)
                key, n = np.unique(label[block.lo + row] * np.int64(_N**3) + gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key // _N**3, pa.int32()), pa.array(key % _N**3, pa.int32()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    seen = sample.mapInArrow(count, "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    lang, gram, n = np.array([tuple(r) for r in seen.toLocalIterator()], np.int64).reshape(-1, 3).T  # at most the sample's trigrams
    model, sound = _model(lang, gram, n, [index[r["declared"]] for r in counts])
    return names, model, [x for x, good in zip(names, sound, strict=True) if good]


#: log probability of a trigram whose bytes are drawn evenly from letters and one separator.
_UND = -3 * np.log(27.0)


def text_scores(docs: DataFrame, names: list[str], fitted: Model) -> DataFrame:
    """Everything but the text, with ll: log likelihood by language and, last, by no language."""
    held = docs.sparkSession.sparkContext.broadcast(fitted)
    k = len(names)

    def run(batches):
        model = held.value
        for batch in batches:
            parts = []
            for block in tb.blocks(batch.column(1)):
                gram, row = _trigrams(block)
                cut = np.searchsorted(row, np.arange(block.rows + 1))
                parts.append(np.column_stack((model.scores(gram, cut), _UND * np.diff(cut))))
            ll = np.concatenate(parts) if parts else np.zeros((0, k + 1))
            lists = tb.list_array(np.full(len(ll), k + 1), ll.reshape(-1), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), lists], names=["id", "declared", "host", "suffix", "ll"])

    return docs.select("id", "text", "declared", "host", "suffix").mapInArrow(run, "id long, declared string, host string, suffix string, ll array<double>")


def _soft(scores: DataFrame, names: list[str]) -> DataFrame:
    """Adds p: the normalised tempered likelihoods of the languages proper (what the grouped counts sum)."""
    ll = F.slice("ll", 1, len(names))
    top = F.array_max(ll)
    e = F.transform(ll, lambda x: F.exp((x - top) * TEMPER))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return scores.withColumn("p", F.transform(e, lambda x: x / total))


def _sums(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """Sums of p by language, in ``by`` groups (partial sums first)."""
    return df.groupBy(*by).agg(*[F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k)])


def posteriors(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs (id, text, declared, host, suffix) -> id, declared, language, posterior, kept."""
    spark = docs.sparkSession
    names, model, sound = fit(docs, sample_rows)
    if not names:
        return docs.select("id", "declared", F.lit(NO_LANGUAGE).alias("language"), F.lit(1.0).alias("posterior"), F.lit(False).alias("kept"))
    k = len(names)
    scores = state.keep(_soft(text_scores(docs, names, model), names), "langid-scores")

    globe = np.array([float(x or 0) for x in _sums(scores, [], k).first()]) + 1.0
    globe /= globe.sum()

    declared_counts = _sums(scores.where("declared is not null"), ["declared"], k)
    # P(declared | language): joined back by the declared value, of which there may be any number
    totals = [float(x or 0) for x in _sums(scores.where("declared is not null"), [], k).first()]
    kinds = max(1, declared_counts.count())
    declared = declared_counts.select(F.col("declared").alias("d_"), F.array(*[F.log((F.col(f"s{i}") + ALPHA) / F.lit(totals[i] + ALPHA * kinds)) for i in range(k)]).alias("log_declared"))

    suffixes = _sums(scores.where("suffix is not null"), ["suffix"], k)
    n = sum((F.col(f"s{i}") for i in range(k)), F.lit(0.0))
    suffix = suffixes.select(F.col("suffix").alias("x_"), F.array(*[(F.col(f"s{i}") + KAPPA * float(globe[i])) / (n + KAPPA) for i in range(k)]).alias("p_suffix"))
    base = F.array(*[F.lit(float(g)) for g in globe])
    hosts = _sums(scores.where("host is not null"), ["host", "suffix"], k).join(suffix, F.col("suffix") == F.col("x_"), "left").withColumn("up", F.coalesce("p_suffix", base))
    host = hosts.select(F.col("host").alias("h_"), F.col("suffix").alias("hs_"), F.array(*[(F.col(f"s{i}") + KAPPA * F.col("up")[i]) / (n + KAPPA) for i in range(k)]).alias("p_host"))
    host = state.keep(host, "langid-hosts")  # so that the join below deals out both sides, and a hot host can be split

    joined = scores.join(F.broadcast(state.keep(declared, "langid-declared")) if kinds * k <= 640000 else declared, F.col("declared") == F.col("d_"), "left")
    joined = joined.join(host, (F.col("host") == F.col("h_")) & F.col("suffix").eqNullSafe(F.col("hs_")), "left")
    zero = F.array(*[F.lit(0.0)] * k)
    joined = joined.withColumn("log_declared", F.coalesce("log_declared", zero)).withColumn("prior", F.coalesce("p_host", base))
    judged = F.col("declared").isNull() | F.col("declared").isin("", *sound)
    logs = F.array(
        *[F.col("ll")[i] * TEMPER + F.col("log_declared")[i] + F.log(F.col("prior")[i]) for i in range(k)],
        F.when(judged, F.col("ll")[k] * TEMPER + F.array_max("log_declared") + F.lit(float(np.log(UND_PRIOR)))).otherwise(float("-inf")),
    )
    joined = joined.withColumn("lp", logs).withColumn("top", F.array_max("lp"))
    best = F.array_position("lp", F.col("top"))
    total = F.aggregate(F.transform("lp", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    language = F.element_at(F.array(*[F.lit(x) for x in [*names, NO_LANGUAGE]]), best.cast("int"))
    return joined.select("id", "declared", language.alias("language"), (1 / total).alias("posterior"), (best <= k).alias("kept"))


def from_documents(docs: DataFrame) -> DataFrame:
    """The table ``documents``: its ``lang`` is what is declared, its ``source`` the host; there is no address."""
    source = F.col("source").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.lower(F.col("lang").cast("string")).alias("declared"), source.alias("host"), F.regexp_extract(source, r"\.([a-z]+)$", 1).alias("suffix")).withColumn("suffix", F.when(F.col("suffix") != "", F.col("suffix")))


def from_pages(pages: DataFrame) -> DataFrame:
    """Raw pages: the markup's language, the host and its address suffix, and the text between tags."""
    some = lambda c: F.when(c != "", c)
    html, url = F.col("html").cast("string"), F.col("url").cast("string")
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return pages.select(
        F.col("page_id").cast("long").alias("id"), text.alias("text"), some(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1))).alias("declared"),
        some(host).alias("host"), some(F.regexp_extract(host, r"\.([a-z]+)$", 1)).alias("suffix"),
    )


def keep_known(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the documents that no language explains; columns as they are."""
    rejected = posteriors(from_documents(docs), sample_rows).where(~F.col("kept") & F.col("id").isNotNull()).select("id").distinct()
    return semi.without(docs, state.keep(rejected, "langid-rejected"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, declared, language, posterior, kept of every document."""
    return posteriors(from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumnRenamed("id", "doc_id")


def langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, declared, language, posterior, kept of every page: markup language, address suffix and host as evidence."""
    return posteriors(from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))).withColumnRenamed("id", "page_id")
