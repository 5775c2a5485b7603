"""From text to vectors: what an embedder is, one that needs no model, and one for ONNX models."""

from __future__ import annotations

import json
from typing import Protocol

import numpy as np

from notefold.chunker.counters import WordPiece, stand_in


MOST_KNOWN = 200_000  # words whose directions a worker keeps
PADDED = (16, 32, 64)  # what a question's tokens are filled up to


def padded_to(tokens: int, window: int) -> int:
    """The length that a question is filled up to: the least of a few, so a model meets few shapes."""
    return min(next((n for n in PADDED if n >= tokens + 2), window + 2), window + 2)


class Embedder(Protocol):
    name: str
    dimensions: int
    window: int  # tokens that the model reads
    budget: int  # tokens of a passage with its prefix

    def count_tokens(self, text: str) -> int: ...

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashedWords:
    """Each token gives a fixed pseudo-random direction; a text is their sum, scaled to length 1.

    Deterministic and without a model, so texts that share words are near each other. For tests and
    where no model can be had.
    """

    def __init__(self, dimensions: int = 64):
        self.name, self.dimensions, self.window, self.budget = f"hashed-words-{dimensions}", dimensions, 126, 110
        self._known: dict[str, np.ndarray] = {}

    def _direction(self, word: str) -> np.ndarray:
        import xxhash

        v = self._known.get(word)
        if v is None:
            if len(self._known) >= MOST_KNOWN:
                self._known.clear()
            v = self._known[word] = np.random.default_rng(xxhash.xxh64_intdigest(word)).standard_normal(self.dimensions, dtype=np.float32)
        return v

    def count_tokens(self, text: str) -> int:
        return stand_in(text)

    def embed(self, texts: list[str]) -> np.ndarray:
        import regex

        find = regex.compile(r"[\p{L}\p{N}\p{M}]+").findall
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in find(t.lower()):
                out[i] += self._direction(w)
            length = np.linalg.norm(out[i])
            if length:
                out[i] /= length
        return out


class OnnxSentences:
    """A BERT-like sentence model from its ``tokenizer.json`` and ONNX files: mean of the tokens' vectors, length 1."""

    def __init__(self, model: str, tokenizer: str, dimensions: int, window: int = 126, budget: int = 110):
        import onnxruntime

        self.name, self.dimensions, self.window, self.budget = model, dimensions, window, budget
        with open(tokenizer, encoding="utf-8") as f:
            spec = json.load(f)
        self.pieces, self.ids = WordPiece(spec), spec["model"]["vocab"]
        self.session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])

    def count_tokens(self, text: str) -> int:
        return self.pieces.count(text)

    def embed(self, texts: list[str]) -> np.ndarray:
        rows = [[self.ids["[CLS]"], *(self.ids[p] for p in self.pieces.tokens(t)[: self.window]), self.ids["[SEP]"]] for t in texts]
        width = max(map(len, rows), default=2)
        width = max(width, padded_to(width - 2, self.window))
        ids = np.array([r + [self.ids.get("[PAD]", 0)] * (width - len(r)) for r in rows], dtype=np.int64)
        mask = np.array([[1] * len(r) + [0] * (width - len(r)) for r in rows], dtype=np.int64)
        given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        named = {i.name for i in self.session.get_inputs()}
        states = self.session.run(None, {k: v for k, v in given.items() if k in named})[0]
        mean = (states * mask[..., None]).sum(axis=1) / mask.sum(axis=1, keepdims=True)
        return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def vector_problem(v: np.ndarray, dimensions: int) -> str | None:
    """Why a vector is of no use, or None."""
    if len(v) != dimensions:
        return "wrong length"
    if not np.isfinite(v).all():
        return "not finite"
    return None if v.any() else "all zero"
