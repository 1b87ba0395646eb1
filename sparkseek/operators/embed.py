"""Text to vectors: WordPiece, a pluggable model, pooling. One Arrow stage, the model opened once a worker."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.functions.analyze import basic_tokens

WORDS = 1 << 17  # of a slice that is encoded at once


class Session(Protocol):
    """A model: token ids, mask and types of one text to (tokens, hidden) floats."""

    def run(self, ids: list[int], mask: list[int], types: list[int]) -> np.ndarray: ...

    def close(self) -> None: ...


@dataclass(frozen=True)
class CallbackSession:
    """A plain function as a model."""

    call: Callable[[list[int], list[int], list[int]], np.ndarray]

    def run(self, ids, mask, types):
        return self.call(ids, mask, types)

    def close(self) -> None:
        pass


class OnnxSession:
    """A model file, by an ONNX runtime where one is installed; token types go in if the model wants them."""

    def __init__(self, path: str, names: tuple[str, str, str] = ("input_ids", "attention_mask", "token_type_ids")):
        import onnxruntime

        self.session, self.names = onnxruntime.InferenceSession(path), names
        self.wanted = {i.name for i in self.session.get_inputs()}

    def run(self, ids, mask, types):
        feed = {n: np.array([v], np.int64) for n, v in zip(self.names, (ids, mask, types)) if n in self.wanted}
        return self.session.run(None, feed)[0][0]

    def close(self) -> None:
        self.session = None


@dataclass(frozen=True)
class EmbedderConfig:
    max_tokens: int = 256
    pooling: str = "mean"
    normalize: bool = True
    query_prefix: str = ""
    passage_prefix: str = ""

    def __post_init__(self):
        if self.max_tokens < 2 or self.pooling not in ("mean", "cls"):
            raise ValueError("max_tokens >= 2, pooling mean or cls")


def parse_vocabulary(text: str) -> dict[str, int]:
    """Line number is id; empty lines before the first token don't count; of repeated tokens the last counts."""
    out: dict[str, int] = {}
    n = 0
    for line in text.split("\n"):
        token = line.rstrip("\r\n")
        if not token and not n:
            continue
        out[token] = n
        n += 1
    return out


class WordPiece:
    def __init__(self, vocabulary: dict[str, int], unknown: str = "[UNK]", cls: str = "[CLS]", sep: str = "[SEP]", max_chars: int = 100, lower: bool = True):
        missing = [t for t in (unknown, cls, sep) if t not in vocabulary]
        if missing:
            raise ValueError(f"not in the vocabulary: {missing}")
        self.vocabulary, self.max_chars, self.lower = vocabulary, max_chars, lower
        self.unknown, self.cls, self.sep = (vocabulary[t] for t in (unknown, cls, sep))

    def pieces(self, word: str) -> list[int]:
        """Longest prefixes first; one piece that isn't there makes the whole word unknown."""
        if len(word) > self.max_chars:
            return [self.unknown]
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                i = self.vocabulary.get(("##" if at else "") + word[at:end])
                if i is not None:
                    break
            else:
                return [self.unknown]
            out.append(i)
            at = end
        return out

    def encode(self, words: list[str], max_tokens: int | None = 256) -> list[int]:
        """With max_tokens None, the whole text."""
        out: list[int] = []
        for w in words:
            out += self.pieces(w)
            if max_tokens is not None and len(out) >= max_tokens - 2:
                break
        return [self.cls, *(out if max_tokens is None else out[: max_tokens - 2]), self.sep]

    def encode_all(self, words: pa.Array, max_tokens: int | None = 256) -> pa.Array:
        """encode of each list of words; each word of a slice is cut once, and numbers stay in 32 bits."""
        sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts, lengths, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        ends = np.cumsum(sizes)
        while at < len(sizes):
            end = max(int(np.searchsorted(ends, ends[at] - sizes[at] + WORDS, "right")), at + 1)
            own = words.slice(at, end - at).flatten().dictionary_encode()
            cut = [self.pieces(w) for w in own.dictionary.to_pylist()]
            flat, first = np.array([i for x in cut for i in x], np.int32), np.cumsum([0, *map(len, cut)])
            which = own.indices.to_numpy()
            n = np.diff(first)[which]
            got = np.repeat(np.arange(end - at), sizes[at:end])
            total = np.bincount(got, n, end - at).astype(np.int64)
            before = np.cumsum(n) - n
            ids = flat[np.arange(n.sum()) + np.repeat(first[which] - before, n)]
            place = np.arange(len(ids)) - np.repeat(np.cumsum(total) - total, total)
            row = np.repeat(np.arange(end - at), total)
            if max_tokens is not None:
                keep = place < max_tokens - 2
                ids, place, row, total = ids[keep], place[keep], row[keep], np.minimum(total, max(max_tokens - 2, 0))
            starts = np.cumsum(total + 2) - (total + 2)
            out = np.full(int((total + 2).sum()), self.sep, np.int32)
            out[starts], out[starts[row] + 1 + place] = self.cls, ids
            parts.append(out)
            lengths.append(total + 2)
            at = end
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)), pa.array(np.concatenate(parts)))


def wordpiece(text: Column, tokenizer: WordPiece, max_tokens: int | None = 256) -> Column:
    """input_ids, attention_mask, token_type_ids; words are split by built-in functions."""

    def run(words: pa.Array) -> pa.Array:
        return tokenizer.encode_all(words, max_tokens)

    ids = F.arrow_udf(run, "array<int>")(basic_tokens(text, tokenizer.lower))
    return F.transform(F.array(ids), lambda i: F.struct(i.alias("input_ids"), F.transform(i, lambda _: F.lit(1)).alias("attention_mask"), F.transform(i, lambda _: F.lit(0)).alias("token_type_ids")))[0]


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Average of the token vectors with a mask other than 0; zeros where there is none, null without tokens."""
    own = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["t"])
    zero = F.transform(F.get(tokens, F.lit(0)), lambda _: F.lit(0).cast("float"))
    total = F.aggregate(own, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.transform(F.array(F.greatest(F.size(own), F.lit(1))), lambda n: F.transform(total, lambda x: (x / n).cast("float")))[0]


def cls_pool(tokens: Column) -> Column:
    """The first token's vector; null without tokens."""
    return F.get(tokens, F.lit(0))


def _pooled(out: np.ndarray, mask: list[int], config: EmbedderConfig) -> np.ndarray:
    kept = out[:1] if config.pooling == "cls" else out[np.array(mask, bool)]
    v = kept.mean(axis=0) if len(kept) else np.zeros(out.shape[1:], np.float32)
    norm = np.sqrt((v * v).sum())
    return (v / norm if config.normalize and norm > 0 else v).astype(np.float32)


def embed(df: DataFrame, tokenizer: WordPiece, open_session: Callable[[], Session], config: EmbedderConfig = EmbedderConfig(), text: str = "text", query: bool = False, out: str = "vector") -> DataFrame:
    """df with its texts' vectors."""
    prefix = config.query_prefix if query else config.passage_prefix

    def run(batches):
        session = open_session()
        try:
            for rows in batches:
                got = []
                for t in rows.to_pylist():
                    ids, mask = t["input_ids"], t["attention_mask"]
                    got.append(_pooled(np.asarray(session.run(ids, mask, t["token_type_ids"]), np.float32), mask, config))
                yield pa.array(got, pa.list_(pa.float32()))
        finally:
            session.close()

    from collections.abc import Iterator

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    value = F.concat(F.lit(prefix), F.coalesce(F.col(text).cast("string"), F.lit("")))
    return df.withColumn(out, F.arrow_udf(run, "array<float>")(wordpiece(value, tokenizer, config.max_tokens)))
