"""The queries of the corpus operators and the SQL that checks them where SQL can."""

from __future__ import annotations

from . import audio, decontam, nbest, neardup, quality, secrets, suffixdedup, tokenstore, toxicity, urlfilter
from .common import table


def op1_secrets(spark, sf_dir):
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op4_decontam(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key", "longest")


def op5_audio(spark, sf_dir):
    return audio.audio_digests(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.site_quality(docs, quality.fit(docs, labels))


def op3_urlfilter(spark, sf_dir):
    return urlfilter.url_verdicts(table(spark, sf_dir, "pages"))


def op7_neardup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4).drop("key")


def op8_nbest(spark, sf_dir):
    return nbest.nbest_digests(table(spark, sf_dir, "documents"))


def op9_tokens(spark, sf_dir):
    return tokenstore.read_documents(tokenstore.write_shards(table(spark, sf_dir, "documents")))


def op10_suffixdedup(spark, sf_dir):
    return suffixdedup.dedup(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_quality": op2_quality,
    "op3_urlfilter": op3_urlfilter,
    "op4_decontam": op4_decontam,
    "op5_audio": op5_audio,
    "op6_toxicity": op6_toxicity,
    "op7_neardup": op7_neardup,
    "op8_nbest": op8_nbest,
    "op9_tokens": op9_tokens,
    "op10_suffixdedup": op10_suffixdedup,
}
ORACLE: dict[str, str] = {"op3_urlfilter": urlfilter.ORACLE, "op4_decontam": decontam.ORACLE}
