"""The corpus pipeline: STAGES in order, each (spark, docs, sf_dir) -> DataFrame.

Every stage works on all that its predecessor kept, and every stage but the last returns
the columns of documents. Each result is written as Parquet and read again as the docs of
the next stage.
"""

from __future__ import annotations

from huestrata.llm.bpe import bpe_encode
from huestrata.llm.common import staged, table
from huestrata.llm.decontaminate import drop_contaminated
from huestrata.llm.exact_dedup import keep_first_copies
from huestrata.llm.minhash import keep_one_of_each
from huestrata.llm.queries import word_bpe_path
from huestrata.llm.toxicity import drop_toxic, train_toxicity


def toxicity(spark, docs, sf_dir):
    """Drops texts that the classifier, trained on the labels of rows that are not held out, scores 0.5 or more."""
    return drop_toxic(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark, docs, sf_dir):
    """Of equal texts, the row with the largest doc_id stays."""
    return keep_first_copies(docs)


def near_copies(spark, docs, sf_dir):
    """Of each group of near-duplicates, the row with the smallest doc_id stays."""
    return keep_one_of_each(docs)


def benchmark_passages(spark, docs, sf_dir):
    """Drops texts that hold a test item, edited or not."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark, docs, sf_dir):
    """doc_id, lang, source and the token ids of each text."""
    return bpe_encode(docs, word_bpe_path()).select("doc_id", "lang", "source", "token_ids")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_passages),
    ("bpe", token_ids),
]
#: Classifier, alignment and tokenizer cannot be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs)
    return docs
