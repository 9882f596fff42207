"""Language identification by Bayesian evidence fusion.

For each document, log-likelihoods of its whole text (letter trigrams, one model a language) are added to those of the
language it declares (markup or metadata), of the last label of its address, and to a prior of its host. Host priors are
smoothed hierarchically: host by registered domain, that by address suffix, that by the whole table. All tables come from
grouped aggregation over all documents: trigram counts by declared language, then soft counts of the texts' posteriors by
host, domain, suffix and declared language.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, cut, drop_since, mark, once, pieces, small, text_batches, trimmed

#: Languages told apart, and the name of everything else.
LANGUAGES, UNKNOWN = ("de", "en", "es", "fr"), "und"
#: Trigrams are of letter classes: separators, a to z, and 37 further classes of other letters.
CLASSES = 64
#: Trigrams of a text that count in full; more are scaled down to this, as they are far from independent.
EFFECTIVE = 200.0
#: Share of trigrams that any language's texts hold of names, codes and the like: a short text is not lost by one key.
NOISE = 0.1
#: Pseudo-counts: of a trigram, of a declared language or suffix, and of the parent's share in a smoothed prior.
TRIGRAM_PRIOR, TABLE_PRIOR, HOST_PRIOR = 0.02, 1.0, 8.0
#: Bytes of text that are turned into trigrams at a time: arrays of some forty times as much live with them.
PIECE = 1 << 20
#: Name of the column of rows' keys in the table of rejected ones.
KEY = "__tidemark_key"
#: Prior share of unknown languages, and the posterior that an accepted document has at least.
UNKNOWN_SHARE, ACCEPT = 0.02, 0.5


def letter_classes() -> np.ndarray:
    """Class of each UTF-16 code unit: 0 for all but letters, 1-26 for a-z, the rest for other letters by their code."""
    out = np.zeros(1 << 16, np.int32)
    for code in range(0x80, 1 << 16):
        if chr(code).isalpha() or 0xD800 <= code < 0xE000:
            out[code] = 27 + ord(chr(code).lower()[0]) % (CLASSES - 27)
    for k in range(26):
        out[0x41 + k] = out[0x61 + k] = k + 1
    return out


def trigrams(texts: list[str | None], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, trigram) of all trigrams within texts that are not separators alone."""
    joined = " \x00".join(t or "" for t in texts) + " "
    units = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), np.uint16)
    owner = np.cumsum(units == 0) if len(texts) > 1 else np.zeros(len(units), np.int64)
    c = classes[units]
    keep = np.concatenate([[True], (c[1:] > 0) | (c[:-1] > 0)]) if len(c) else np.zeros(0, bool)  # runs of separators are one
    c, owner = c[keep], owner[keep]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
    ok = (owner[:-2] == owner[2:]) & (c[1:-1] > 0)
    return owner[:-2][ok], code[ok]


def _count(languages: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, rank = once("letter classes", letter_classes), {n: i for i, n in enumerate(languages)}
        total = np.zeros(len(languages) * CLASSES**3, np.int64)
        for whole in batches:
            for batch in pieces(whole, most=PIECE):
                texts = [(t or "").replace("\x00", " ") for t in batch.column("text").to_pylist()]
                row = np.array([rank[x] for x in batch.column("declared").to_pylist()], np.int64)
                owner, code = trigrams(texts, classes)
                total += np.bincount(row[owner] * CLASSES**3 + code, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    return run


def fit_text(documents: DataFrame, text: Column, declared: Column, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log-probabilities of trigrams by language, the unknown language last (even over four times the trigrams that occur at all).
    Counts cover all documents that declare one of the languages; the table has at most languages * CLASSES**3 cells."""
    rows = documents.select(text.alias("text"), declared.alias("declared")).where(F.col("declared").isin(*languages) & F.col("text").isNotNull())
    counts = np.zeros((len(languages), CLASSES**3))
    for r in rows.mapInArrow(trimmed(_count(languages)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.ravel()[r["cell"]] = r["n"]
    counts += TRIGRAM_PRIOR
    alien = 1 / max(2, 4 * int((counts.sum(0) > len(languages) * TRIGRAM_PRIOR + 0.5).sum()))
    known = np.log((1 - NOISE) * counts / counts.sum(axis=1, keepdims=True) + NOISE * alien)
    return np.vstack([known, np.full((1, known.shape[1]), math.log(alien))]).astype(np.float32)


def _likelihoods(table: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = once("letter classes", letter_classes)
        for whole in batches:
            for batch in pieces(whole, most=PIECE):
                texts = [(t or "").replace("\x00", " ") for t in batch.column("text").to_pylist()]
                owner, code = trigrams(texts, classes)
                n = np.bincount(owner, minlength=len(texts))
                scale = np.minimum(1, EFFECTIVE / np.maximum(n, 1))
                sums = np.stack([np.bincount(owner, t[code], len(texts)) * scale for t in table], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(sums.tolist(), pa.list_(pa.float64()))], [*batch.schema.names, "n_trigrams", "text_ll"])

    return run


def _posterior(logs: str) -> str:
    """SQL of the softmax of an array of logs."""
    return f"transform({logs}, x -> exp(x - array_max({logs})) / aggregate({logs}, 0D, (s, y) -> s + exp(y - array_max({logs}))))"


def _sums(k: int) -> list[Column]:
    return [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k)]


def _array(k: int) -> Column:
    return F.array(*[F.col(f"s{i}") for i in range(k)])


def _judged(
    documents: DataFrame, kept: list[Column], text: Column, declared: Column | None, url: Column | None, host: Column | None, languages: tuple[str, ...], accept: float, model: np.ndarray | None
) -> DataFrame:
    """The kept columns as k0, k1, ... and lang, posterior, accepted, declared, n_trigrams for each row."""
    text_batches(documents.sparkSession)
    none = F.lit(None).cast("string")
    code = F.lower(F.regexp_extract(F.coalesce(none if declared is None else declared, F.lit("")), r"^\s*([A-Za-z]+)", 1))
    site = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)) if url is not None else F.coalesce(none if host is None else host, F.lit(""))
    labels = F.split(site, r"\.")
    dotted = F.size(labels) > 1
    names = (*languages, UNKNOWN)
    k = len(names)
    own = [f"k{i}" for i in range(len(kept))]
    rows = documents.select(
        *[c.alias(n) for c, n in zip(kept, own)], text.alias("text"), code.alias("declared"), site.alias("host"),
        F.when(dotted, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(F.lit("")).alias("domain"),
        F.when(dotted, F.element_at(labels, -1)).otherwise(F.lit("")).alias("suffix"),
    )
    table = fit_text(rows, F.col("text"), F.col("declared"), languages) if model is None else model
    seen = rows.mapInArrow(trimmed(_likelihoods(table)), T.StructType([*rows.schema.fields, T.StructField("n_trigrams", T.LongType()), T.StructField("text_ll", T.ArrayType(T.DoubleType()))]))
    seen = cut(seen.drop("text"))
    # How many hosts, codes and suffixes there are, about: decides on files alone.
    about = seen.agg(*[F.approx_count_distinct(c) for c in (F.struct("host", "domain", "suffix"), F.col("declared"), F.col("suffix"))]).first()
    n_fine, n_code, n_suffix = (int(x or 0) for x in about)
    flat = f"transform(text_ll, (x, i) -> x + case when i = {k - 1} then {math.log(UNKNOWN_SHARE)} else {math.log((1 - UNKNOWN_SHARE) / (k - 1))} end)"
    soft = seen.withColumn("p", F.expr(f"transform({flat}, x -> x)")).withColumn("p", F.expr(_posterior("p"))).where("n_trigrams > 0")
    # Soft counts at the finest level; coarser levels are sums of them, so documents are aggregated once.
    fine = cut(soft.groupBy("host", "domain", "suffix").agg(*_sums(k)), n_fine)
    up = lambda *by: fine.groupBy(*by).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
    totals = up().first()
    share = np.array([(totals[f"s{i}"] or 0.0) for i in range(k)]) + 1.0
    share[-1] = UNKNOWN_SHARE * share[:-1].sum() / (1 - UNKNOWN_SHARE) if share[-1] < UNKNOWN_SHARE * share.sum() else share[-1]
    share /= share.sum()
    whole = F.array(*[F.lit(float(x)) for x in share])
    smooth = lambda counts, parent: F.expr(f"transform({counts}, (x, i) -> (x + {HOST_PRIOR} * {parent}[i]) / (aggregate({counts}, 0D, (s, y) -> s + y) + {HOST_PRIOR}))")
    by_suffix = up("suffix").select("suffix", _array(k).alias("cs")).withColumn("root", whole).withColumn("ps", smooth("cs", "root")).select("suffix", "ps")
    by_domain = up("suffix", "domain").select("suffix", "domain", _array(k).alias("cd"))
    hosts = fine.select("host", "domain", "suffix", _array(k).alias("ch"))
    priors = hosts.join(by_domain, ["suffix", "domain"]).join(by_suffix, "suffix").withColumn("pd", smooth("cd", "ps")).withColumn("prior", smooth("ch", "pd")).select("host", "prior")
    priors = cut(priors, n_fine)

    # ln P(code | language) of declared languages and of suffixes, one row a code; a code that no text backs is no evidence.
    def with_evidence(df: DataFrame, column: str, name: str, about: int) -> DataFrame:
        codes = cut(soft.where(F.col(column) != "").groupBy(column).agg(*_sums(k)), about)
        row = codes.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(k)]).first()
        logs = [F.log((F.col(f"s{i}") + TABLE_PRIOR) / (row[f"s{i}"] + TABLE_PRIOR * (row["n"] + 1))) for i in range(k)]
        side = small(codes.select(column, F.array(*logs).alias(name)), row["n"], BROADCAST_ROWS // 8)
        return df.join(side, column, "left").withColumn(name, F.coalesce(name, F.array(*[F.lit(0.0)] * k)))

    n_hosts = priors.count()
    joined = seen.join(F.broadcast(priors) if n_hosts <= BROADCAST_ROWS // 8 else priors, "host", "left")
    fused = with_evidence(with_evidence(joined.withColumn("prior", F.coalesce("prior", whole)), "declared", "dl", n_code), "suffix", "sl", n_suffix)
    fused = fused.withColumn("logs", F.expr("transform(text_ll, (x, i) -> x + ln(prior[i]) + dl[i] + sl[i])")).withColumn("post", F.expr(_posterior("logs")))
    at = F.array_position("post", F.array_max("post")).cast("int")
    best = F.element_at(F.array(*map(F.lit, names)), at)
    return fused.select(
        *own, best.alias("lang"), F.array_max("post").alias("posterior"),
        ((F.col("n_trigrams") > 0) & (best != UNKNOWN) & (F.array_max("post") >= accept)).alias("accepted"), F.col("declared").alias("declared"), "n_trigrams",
    )


def identify(
    documents: DataFrame, *, id_col: str = "doc_id", text: Column | None = None, declared: Column | None = None, url: Column | None = None,
    host: Column | None = None, languages: tuple[str, ...] = LANGUAGES, accept: float = ACCEPT, model: np.ndarray | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """One row per document: the id, the `keep` columns, lang, posterior, accepted, declared and n_trigrams.

    text, declared and url (or host) are expressions; a missing one is no evidence. Declared codes are cut at '-' or '_' and
    lower-cased, the suffix is the host's last label, the domain its last two. A text without letters has no evidence of its
    own and is never accepted; other documents are accepted if the posterior of their best language reaches `accept` and it
    is a known one. Null texts count as empty; null hosts share the table's prior. Very long texts are read whole. Ties go to
    the language named first. Repeated rows each give a row. An empty table gives none. Kept columns may have any name but
    those of the result.
    """
    names = [id_col, *[c for c in keep or [] if c != id_col]]
    found = _judged(documents, [F.col(c) for c in names], F.col("text") if text is None else text, declared, url, host, languages, accept, model)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "lang", "posterior", "accepted", "declared", "n_trigrams")


def html_lang(html: Column) -> Column:
    """The language that markup declares: the lang attribute of the html element; empty if there is none, null for null."""
    return F.regexp_extract(F.regexp_extract(html, r"(?i)<html\b([^>]*)", 1), r"(?i)\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1)


def html_text(html: Column) -> Column:
    """Text of markup, good enough for letter statistics: without scripts, styles, comments and tags. What is never closed
    reaches to the end, so the time is in proportion to the page."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)", " ")
    return F.regexp_replace(bare, r"<[^>]*(?:>|\z)|&[A-Za-z0-9#]+;", " ")


def of_documents(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """identify() for a table that declares languages in `lang` and hosts in `source`; `declared` is that column, normalised."""
    return identify(documents, declared=F.col("lang"), host=F.col("source"), keep=keep)


def accepted(documents: DataFrame) -> DataFrame:
    """The documents whose language is told and known, all columns. The evidence is a row's text, declared language and host
    alone, so rows are judged by these: rows that share an id or have none are documents like all others. Texts without
    letters (null, empty) go; very long texts are read whole; repeated rows fare alike; an empty table stays empty. Columns
    may have any name."""
    spark = documents.sparkSession
    point = mark()
    given = [F.col("lang"), F.col("source"), F.col("text")]
    key = F.unhex(F.md5(F.concat(*[F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in given])))
    found = _judged(documents, [key], F.col("text"), F.col("lang"), None, F.col("source"), LANGUAGES, ACCEPT, None)
    gone = cut(found.where("not accepted").select(F.col("k0").alias(KEY)).distinct())
    drop_since(spark, point)
    return documents.join(small(gone, gone.count(), BROADCAST_ROWS // 2), key == F.col(KEY), "left_anti")
