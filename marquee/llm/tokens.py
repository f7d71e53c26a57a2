"""Encoding of whole texts with a public byte-level BPE vocabulary.

Texts up to `chunk` characters are encoded directly, in batches. A longer text is cut into chunks that overlap;
every chunk is split into pre-tokens on its own, in parallel; where a chunk and its predecessor share a
pre-token boundary inside the overlap, they agree from there on (a pre-token depends only on the text to its
right), so the text is cut there; the pieces are encoded on their own and their ids are put together by
position. A boundary near the end of a window may depend on text beyond it, so it does not count. Where a run
without boundaries is longer than the overlap, the chunks stay one piece, whatever its length.

Null and empty texts have no ids (an empty list). Strings of special tokens are ordinary text. Lone surrogates
become the replacement character. `decode` concatenates the bytes of the ids and returns the text exactly.
Repeated rows come out as often as they came in; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import checkpointed, tokenizer_dir

#: Pre-tokens of byte_bpe_50k: the vocabulary's public pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 16_384
OVERLAP = 512


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    out = {}
    with Path(path).open("rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                out[base64.b64decode(token)] = int(rank)
    return out


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k", folder: str | None = None):
    """The encoder of the vocabulary `name` in the tokenizers' folder."""
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks_of(f"{folder or tokenizer_dir()}/{name}.tiktoken"), special_tokens={})


def clean(text: str) -> str:
    """`text` without lone surrogates."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def encode(text: str | None, name: str = "byte_bpe_50k", folder: str | None = None) -> list[int]:
    return encoder(name, folder).encode_ordinary(clean(text)) if text else []


def decode(ids: list[int], name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return b"".join(encoder(name, folder).decode_single_token_bytes(i) for i in ids).decode("utf-8", "replace")


_split = regex.compile(PATTERN)


def boundaries(window: str, at_end: bool) -> list[int]:
    """Ends of the pre-tokens of `window`, 0 first; without the last two if the text goes on behind the window."""
    ends = [0] + [m.end() for m in _split.finditer(window)]
    return ends if at_end else ends[:-2]


def windows(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, str, bool]]:
    """(number, start, window, whether the text ends with it) of a text's overlapping chunks."""
    for i, s in enumerate(range(0, len(text), chunk)):
        yield i, s, text[s : s + chunk + overlap], s + chunk + overlap >= len(text)


def edges(start: int, window: str, at_end: bool, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries of a chunk within its own first `overlap` characters, and within the overlap with the next one."""
    ends = boundaries(window, at_end)
    return [start + e for e in ends if e <= overlap], [start + e for e in ends if chunk <= e <= chunk + overlap]


def stitch(text: str, heads: list[list[int]], tails: list[list[int]], chunk: int, overlap: int) -> list[int]:
    """Positions at which `text` may be cut, 0 first: the first boundary that each chunk shares with the part before it.

    Not behind white space: how a run of it is split depends on what follows. Where a chunk shares none, the part before it goes on: its boundaries in the next overlap are found from the
    last boundary that is known to be right.
    """
    cuts, sure, last = [0], set(tails[0]), max(tails[0], default=0)
    bare = 0  # how far behind `last` no boundary was found
    for i in range(1, len(heads)):
        common = [c for c in heads[i] if c in sure and c > cuts[-1] and not text[c - 1].isspace()]
        if common:
            cuts.append(common[0])
            sure = {t for t in tails[i] if t >= common[0]}
            last, bare = max(sure, default=common[0]), 0
            continue
        stop = min((i + 1) * chunk + overlap, len(text))
        if len(heads[i]) <= 1 and stop - last < 2 * bare and stop < len(text):
            sure = set()  # within a run; looked at again when it has doubled, so it is scanned in linear time
            continue
        ends = [last + e for e in boundaries(text[last:stop], stop >= len(text))]
        sure = {e for e in ends if e >= (i + 1) * chunk}
        new = max(ends, default=last)
        bare = stop - last if new == last else 0
        last = new
    return cuts


def pieces_of(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The pieces of one text that may be encoded on their own."""
    pairs = [edges(s, w, e, chunk, overlap) for _, s, w, e in windows(text, chunk, overlap)]
    cuts = stitch(text, [h for h, _ in pairs], [t for _, t in pairs], chunk, overlap) if pairs else [0]
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def parts(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """The batches in parts of few rows, so that the ids of one part fit a worker whatever the texts."""
    for b in batches:
        for n in range(0, len(b), rows):
            yield b.iloc[n : n + rows]


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", chunk: int = CHUNK, overlap: int = OVERLAP, folder: str | None = None) -> DataFrame:
    """(key, ids) of every row."""
    folder = folder or tokenizer_dir()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts(batches):
            yield pd.DataFrame({"key": b["key"], "ids": [encode(t, name, folder) for t in b["text"]]})

    direct = rows.where(size <= chunk).mapInPandas(whole, "key bigint, ids array<int>")
    # every row gets a number of its own, so that repeated rows stay apart; written down, as the number must not change
    long = checkpointed(rows.where(size > chunk).withColumn("row", F.monotonically_increasing_id()))

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row, t in zip(b["row"], b["text"]):
                many: list[tuple] = []
                for w in windows(clean(t), chunk, overlap):
                    many.append((row, *w))
                    if len(many) == 64:
                        yield pd.DataFrame(many, columns=["row", "i", "start", "window", "at_end"])
                        many = []
                yield pd.DataFrame(many, columns=["row", "i", "start", "window", "at_end"])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [edges(s, w, e, chunk, overlap) for s, w, e in zip(b["start"], b["window"], b["at_end"])]
            yield pd.DataFrame({"row": b["row"], "i": b["i"], "head": [h for h, _ in found], "tail": [t for _, t in found]})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row, t, ends in zip(b["row"], b["text"], b["ends"]):
                t, ends = clean(t), sorted(ends, key=lambda x: x["i"])
                cuts = stitch(t, [list(x["head"]) for x in ends], [list(x["tail"]) for x in ends], chunk, overlap)
                many = [(row, i, t[p:q]) for i, (p, q) in enumerate(zip(cuts, [*cuts[1:], len(t)]))]
                for n in range(0, len(many), 64):
                    yield pd.DataFrame(many[n : n + 64], columns=["row", "i", "text"])

    def piece(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts(batches):
            yield pd.DataFrame({"row": b["row"], "i": b["i"], "ids": [encode(t, name, folder) for t in b["text"]]})

    found = long.select("row", "text").mapInPandas(spans, "row bigint, i int, start bigint, window string, at_end boolean").repartition("row", "i").mapInPandas(split, "row bigint, i int, head array<bigint>, tail array<bigint>")
    ends = found.groupBy("row").agg(F.collect_list(F.struct("i", "head", "tail")).alias("ends"))
    pieces = long.select("row", "text").join(ends, "row").mapInPandas(cut, "row bigint, i int, text string").repartition("row", "i").mapInPandas(piece, "row bigint, i int, ids array<int>")
    joined = pieces.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda x: x["ids"])).alias("ids"))
    whole_long = long.select("row", "key").join(joined, "row").select("key", "ids")
    return direct.unionByName(whole_long).select(F.col("key").alias(key), "ids")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, tokens) of every row."""
    return encode_documents(docs, key, text, **options).select(key, F.size("ids").alias("tokens"))
