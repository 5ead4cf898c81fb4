"""Text to padded ids: normalise, pre-tokenise, split into subwords, template, pad."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import sequences, text
from threadloom.operators.vocabulary import SPECIAL
from threadloom.subword.models import BPE, SubwordModel
from threadloom.subword.words import word_counts


@dataclass
class TokenizationPipeline:
    """Normalise, split, byte letters, a subword model fitted on the corpus, template, padding.

    Every part can be replaced: ``normaliser`` is a function of a text column, ``splitter``
    one from text to an array of tokens (a pattern name stands for `split_keep`),
    ``byte_letters`` says whether tokens are written as byte letters, and ``kind`` is a
    subword class with ``fit``. ``encode`` cuts to ``max_length``, adds ``items`` around the
    sequence and pads to ``max_length``, so a row may be two longer; ``strict`` cuts
    earlier by the number of items.
    """

    pattern: str = "gpt4o"
    merges: float = 0.35
    model: SubwordModel | None = None
    normaliser: Callable[[Column], Column] = partial(text.unicode_form, form="NFC")
    splitter: Callable[[Column], Column] | None = None
    byte_letters: bool = True
    kind: type[SubwordModel] = BPE
    special: dict[str, str] = field(default_factory=lambda: dict(SPECIAL))
    items: tuple[str, ...] = (SPECIAL["bos_token"], "$", SPECIAL["eos_token"])
    cut_side: str = "right"
    pad_side: str = "right"

    def pre_tokens(self, docs: DataFrame, column: str = "text") -> DataFrame:
        split = self.splitter or partial(text.split_keep, pattern=text.PATTERNS[self.pattern])
        tokens = split(self.normaliser(F.col(column)))
        return docs.withColumn("tokens", F.transform(tokens, text.byte_level) if self.byte_letters else tokens)

    def fit(self, docs: DataFrame, column: str = "text") -> TokenizationPipeline:
        self.model = self.kind.fit(word_counts(self.pre_tokens(docs, column)), self.merges, self.special)
        return self

    def tokenize(self, docs: DataFrame, column: str = "text") -> DataFrame:
        rows = self.pre_tokens(docs, column)
        return rows.withColumn("subtokens", F.flatten(F.transform(self.model.tokenize(F.col("tokens")), lambda t: t["subtokens"]))).drop("tokens")

    def encode(self, docs: DataFrame, max_length: int, column: str = "text", strict: bool = False) -> DataFrame:
        rows = self.pre_tokens(docs, column).withColumn("ids", self.model.encode(F.col("tokens"))).drop("tokens")
        room = max(max_length - len(self.items) + 1, 0) if strict else max_length
        rows = rows.withColumn("ids", sequences.truncate(F.col("ids"), room, self.cut_side)).withColumn("attention_mask", sequences.ones(F.col("ids")))
        ids = {t: k for k, t in enumerate(self.special.values())}
        tokens, mask = sequences.template(F.col("ids"), F.col("attention_mask"), list(self.items), ids, set(self.special.values()))
        rows = rows.withColumns({"ids": tokens, "attention_mask": mask})
        pad = ids[self.special["pad_token"]]
        padded = {c: sequences.pad(F.col(c), max_length, value, self.pad_side) for c, value in (("ids", pad), ("attention_mask", 0))}
        return rows.withColumns(padded)
