"""The queries of this subpackage: thin, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracles
from .common import is_held, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark, sf_dir):
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_embeddings(spark, sf_dir):
    from .embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_packing(spark, sf_dir):
    from .packing import pack_documents

    out = pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_varbytes(spark, sf_dir):
    from .varbytes import read_ids, write_ids

    path, ranked = write_ids(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return read_ids(spark, path, ranked).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_secrets(spark, sf_dir):
    from .secrets import scan

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = F.expr("filter(spans, s -> s.kind != 'literal')")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}")
    return scan(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_language(spark, sf_dir):
    from .language import predict, train

    docs = table(spark, sf_dir, "documents")
    held = is_held("doc_id", 3, 1)
    model = train(docs.where(~held))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model).drop("text")


def op3_brown(spark, sf_dir):
    from .brown import score

    docs = table(spark, sf_dir, "documents")
    held = is_held("doc_id", 10, 0)
    return score(docs, ~held).withColumn("held_out", held)


def op10_decontaminate(spark, sf_dir):
    from .decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_automata(spark, sf_dir):
    from .automata import deduplicate

    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_suffixes(spark, sf_dir):
    from .suffixes import deduplicate

    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_toxicity(spark, sf_dir):
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    held = is_held("doc_id", 5, 0)
    model = train(docs.where(~held), table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text", held.alias("held_out")), model).drop("text")


def op12_collocations(spark, sf_dir):
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_divergence(spark, sf_dir):
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": op1_simhash, "op3_brown": op3_brown, "op4_embeddings": op4_embeddings, "op2_packing": op2_packing, "op5_varbytes": op5_varbytes, "op6_automata": op6_automata, "op7_secrets": op7_secrets, "op8_language": op8_language, "op9_suffixes": op9_suffixes, "op10_decontaminate": op10_decontaminate, "op11_toxicity": op11_toxicity, "op12_collocations": op12_collocations, "op13_divergence": op13_divergence}
#: The others turn on tokenizers, on a trained model, on XXH64 or on positions of matches, which SQL lacks; tests hold them against brute force.
ORACLES = {"op4_embeddings": oracles.EMBEDDINGS, "op6_automata": oracles.AUTOMATA, "op9_suffixes": oracles.SUFFIXES, "op10_decontaminate": oracles.DECONTAMINATE, "op12_collocations": oracles.COLLOCATIONS, "op13_divergence": oracles.DIVERGENCE}
