"""Embedders. The default hashes words and word pairs with signs into a unit vector, so that it needs
no model; a local ONNX model can be used where its directory is given."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

RESULT = "struct<embedding: array<float>, truncated: boolean>"
#: Models that can be chosen, by the name under which they are published (fixed values); all have 384 dimensions.
MODELS = {
    "sentence-transformers/all-MiniLM-L6-v2": "MiniLM-L6 (fast, default)",
    "sentence-transformers/all-MiniLM-L12-v2": "MiniLM-L12 (slower, more accurate)",
    "BAAI/bge-small-en-v1.5": "BGE-small (retrieval-tuned)",
    "thenlper/gte-small": "GTE-small (retrieval-tuned)",
}


class HashingEmbedder:
    """Signed feature hashing to `dim`, L2-normalised. Texts above `max_tokens` words are cut and marked."""

    def __init__(self, dim: int = 384, max_tokens: int = 512):
        self.dim, self.max_tokens = dim, max_tokens
        self.model = f"hashing-{dim}"

    def embed(self, text: str) -> tuple[list[float], bool]:
        words = re.findall(r"[^\W_]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", text or "").lower())
        used = words[: self.max_tokens]
        out = np.zeros(self.dim)
        for t, w in [(x, 1.0) for x in used] + [(f"{a} {b}", 0.5) for a, b in zip(used, used[1:])]:
            h = hashlib.md5(t.encode(), usedforsecurity=False).digest()
            out[int.from_bytes(h[3:] + h[:1], "big") % self.dim] += w if h[1] & 1 else -w
        norm = np.linalg.norm(out)
        return (out / norm if norm else out).astype(np.float32).tolist(), len(words) > self.max_tokens

    def embed_many(self, texts: list[str]) -> list[tuple[list[float], bool]]:
        return [self.embed(t) for t in texts]


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of each text's token vectors (texts, tokens, dim) where the mask is 1, L2-normalised."""
    weight = mask[:, :, None].astype(np.float64)
    mean = (hidden * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


class OnnxEmbedder:
    """Mean pooling over a BERT-like model in a local directory (model.onnx, tokenizer.json), L2-normalised."""

    def __init__(self, directory: str, max_tokens: int = 512, batch: int = 32):
        self.directory, self.max_tokens, self.batch, self.model, self._loaded = directory, max_tokens, batch, directory.rstrip("/").rsplit("/", 1)[-1], None

    def __getstate__(self):
        return self.__dict__ | {"_loaded": None}

    def embed(self, text: str) -> tuple[list[float], bool]:
        return self.embed_many([text])[0]

    def embed_many(self, texts: list[str]) -> list[tuple[list[float], bool]]:
        """Texts are run in batches of like length, so that few tokens are padding."""
        if self._loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            self._loaded = onnxruntime.InferenceSession(f"{self.directory}/model.onnx"), Tokenizer.from_file(f"{self.directory}/tokenizer.json")
        session, tokenizer = self._loaded
        every = [e.ids for e in tokenizer.encode_batch([t or "" for t in texts])]
        out: list = [None] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: len(every[i]))
        for low in range(0, len(order), self.batch):
            part = order[low : low + self.batch]
            cut = [every[i][: self.max_tokens] for i in part]
            width = max(1, *map(len, cut))
            ids = np.array([[*x, *[0] * (width - len(x))] for x in cut], np.int64)
            mask = np.array([[1] * len(x) + [0] * (width - len(x)) for x in cut], np.int64)
            feed = {i.name: np.zeros_like(ids) if "type" in i.name else mask if "mask" in i.name else ids for i in session.get_inputs()}
            for i, v in zip(part, pooled(session.run(None, feed)[0], mask), strict=True):
                out[i] = v.astype(np.float32).tolist(), len(every[i]) > self.max_tokens
        return out


def embed_udf(embedder):
    """A column function from text to struct<embedding, truncated>, in Arrow batches."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        got = embedder.embed_many(list(texts))
        return pd.DataFrame({"embedding": [g[0] for g in got], "truncated": [g[1] for g in got]})

    return run
