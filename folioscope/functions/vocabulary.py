"""Vocabulary, cue-phrase and claim matching as column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from folioscope.functions.text import WS, sentences, strip

# Benchmark dataset names recognised by default.
DATASETS = [
    "Cora", "Citeseer", "PubMed", "Reddit", "PPI",
    "ImageNet", "CIFAR-10", "CIFAR-100", "MNIST", "Fashion-MNIST",
    "COCO", "Pascal VOC", "ADE20K", "Cityscapes",
    "SQuAD", "GLUE", "SuperGLUE", "WikiText", "WikiText-2", "WikiText-103",
    "Penn Treebank", "CoNLL-2003", "OntoNotes",
    "MS MARCO", "Natural Questions", "TriviaQA", "HotpotQA",
    "LibriSpeech", "CommonVoice", "AudioSet",
    "OGB", "OGB-Arxiv", "OGB-Products", "ogbn-arxiv",
    "WordNet", "FB15k", "FB15k-237", "WN18", "WN18RR",
]

# Evaluation metric names recognised by default.
METRICS = [
    "accuracy", "precision", "recall", "F1", "F1-score", "F1 score",
    "AUC", "AUROC", "mAP", "mean average precision",
    "BLEU", "ROUGE", "ROUGE-L", "METEOR", "perplexity",
    "MSE", "RMSE", "MAE", "R2", "top-1 accuracy", "top-5 accuracy",
    "NDCG", "MRR", "hit rate", "hits@1", "hits@10",
]

# Phrases that announce a method name, the article that may
# follow, the shape of one name word, and the longest name in words.
CUES = ["we propose", "we introduce", "we present"]
ARTICLES = ["a", "an", "the"]
NAME_WORD = r"[A-Z][A-Za-z0-9\-]*"
MAX_NAME_WORDS = 5

# What makes a sentence a quantified claim.
CLAIM_NUMBER = r"(?iU)\b\d{1,3}(?:\.\d+)?\s*(?:%|percent\b|points?\b|pp\b)"


def _quoted(name: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", name)


def _layers(vocabulary: list[str]) -> list[list[str]]:
    """Split names so that none starts with another of its layer: one scan per
    layer then finds every name, also where a longer one begins at the same place."""
    layers: list[list[str]] = []
    for name in sorted(set(vocabulary), key=lambda n: (len(n), n)):
        low = name.lower()
        for layer in layers:
            if not any(low.startswith(seen.lower()) for seen in layer):
                layer.append(name)
                break
        else:
            layers.append([name])
    return layers


def vocabulary_hits(c: Column, vocabulary: list[str]) -> Column:
    """Distinct names of ``vocabulary`` occurring as whole words, any case, in
    canonical spelling, sorted.

    The text is scanned once per prefix layer (two or three for the default
    lists), not once per name; the look-ahead consumes nothing, so overlapping
    names are all found.
    """
    spelling: dict[str, list[str]] = {}
    for name in dict.fromkeys(vocabulary):
        spelling.setdefault(name.lower(), []).append(name)
    if not spelling:
        return F.array().cast("array<string>")
    found = F.flatten(
        F.array(
            *[
                F.regexp_extract_all(
                    c, F.lit(rf"(?iU)\b(?=({'|'.join(map(_quoted, layer))})\b)"), F.lit(1)
                )
                for layer in _layers(vocabulary)
            ]
        )
    )
    # one pass over upper folds letters that are only case variants of ASCII
    keys = F.array_distinct(F.transform(found, lambda m: F.lower(F.upper(m))))
    canonical = F.create_map(
        *[
            cell
            for low, names in spelling.items()
            for cell in (F.lit(low), F.array(*map(F.lit, names)))
        ]
    )
    names = F.transform(keys, lambda k: F.try_element_at(canonical, k))
    return F.array_sort(F.coalesce(F.flatten(F.array_compact(names)), F.array().cast("array<string>")))


def cue_names(
    c: Column,
    cues: list[str] = CUES,
    name_word: str = NAME_WORD,
    max_words: int = MAX_NAME_WORDS,
    articles: list[str] = ARTICLES,
) -> Column:
    """Names announced by a cue phrase, ordered by cue then position, each once."""
    article = "(?:" + "|".join(rf"{a}{WS}+" for a in articles) + ")?" if articles else ""
    name = rf"({name_word}(?:{WS}+{name_word}){{0,{max_words - 1}}})"
    per_cue = [
        F.regexp_extract_all(c, F.lit(rf"(?iu:{_quoted(cue)}){WS}+{article}{name}"), F.lit(1))
        for cue in cues
    ]
    return F.array_distinct(F.transform(F.concat(*per_cue), strip))


def claim_sentences(c: Column, number_pattern: str = CLAIM_NUMBER) -> Column:
    """Sentences holding a quantified figure, trimmed, in text order."""
    kept = F.filter(sentences(c), lambda s: s.rlike(number_pattern))
    return F.transform(kept, strip)
