"""Byte-pair encoding by forced boundaries, and decoding."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import small_batches

#: White space at which fragments may begin.
SPACES = " \t\n\r\x0b\x0c"
#: Characters of a fragment that is worth remembering, and of all that a worker remembers before it starts afresh.
SHORT, REMEMBERED = 64, 1 << 23


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBpe:
    """Encoder of a byte-level BPE ``tokenizer.json`` (no normalizer, no prefix space).

    A merge only makes tokens of the vocabulary, so two neighbouring bytes that no token holds side by side always belong to
    different tokens: a forced boundary. Text is cut at these in two steps. Where the left character is not white space and the
    right one is, no piece of the splitting pattern spans the place or looks across it, so the text is cut there before the pattern
    is applied. The pattern's pieces in each fragment are then cut at all other forced boundaries, and what is left is
    merged on its own. The ids are concatenated. Short fragments are encoded once. Special tokens in a text are cut out first, as the library does.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letters = byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.joined = {pair for t in self.bytes_of.values() for pair in zip(t, t[1:], strict=False)}
        # [^\S ...]: white space other than SPACES; a fragment goes on over it
        self.rare = re.compile(r"[^\S \t-\r]")
        self.plain = re.compile(r"\s*\S+|\s+")
        self.fragment = re.compile(r"\s*\S+(?:[^\S \t-\r]\s*\S*)*|\s+")
        self.open_cuts = {(b, ord(s)) for b in range(256) for s in SPACES if (b, ord(s)) in self.joined and not chr(b).isspace()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # most fragments: what the splitting pattern makes of them is plain from it
        self.letters, self.common = letters, re.compile(r"(\n?)( ?[A-Za-zÀ-ÖØ-öø-ʯ]+)([.,;:!?]*)")
        self.plain_bytes = {ord(c): b for c, b in letters.items()}
        self.forced = np.ones((256, 256), bool)
        for x, y in self.joined:
            self.forced[x, y] = False
        self.merged = self._ranked(spec) or self._library
        self.known = _Known(self._encode)
        self._forget()
        self.table = [self.bytes_of[i] for i in range(len(self.bytes_of))] if set(self.bytes_of) == set(range(len(self.bytes_of))) else self.bytes_of

    def _library(self, piece: bytes) -> list[int]:
        """Merge the bytes of a piece, without the splitting pattern."""
        return [t.id for t in self.tokenizer.model.tokenize("".join(map(self._letter_of().__getitem__, piece)))]

    @lru_cache(maxsize=1)  # noqa: B019
    def _letter_of(self) -> dict[int, str]:
        return {b: c for c, b in self.letters.items()}

    def _ranked(self, spec: dict):
        """Merging by ranks, which gives the same ids in a tenth of the time for a short piece, or None.

        It merges any neighbours whose bytes make a token, the library only listed pairs. The two agree if ids follow the
        order of the merges and the listed merges turn the bytes of each token into that token: neighbours x, y that
        are not listed but make a token t can't arise, as the library would then be left with x, y for t alone.
        """
        import tiktoken
        from public_tokenizers import PATTERN

        vocab, special = spec["model"]["vocab"], self.special
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        ordered = all(a < b for a, b in zip(made, made[1:], strict=False)) and (not made or len(vocab) - len(made) - len(special.keys() & vocab.keys()) == made[0])
        whole = self.tokenizer.model.tokenize
        if not ordered or any(len(whole(t)) != 1 for t in vocab if t not in special):
            return None
        ranks = {self.bytes_of[i]: i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("by-rank", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def pieces(self, fragment: str) -> list[bytes]:
        """The pattern's pieces of a fragment, cut at forced boundaries."""
        if (m := self.common.fullmatch(fragment)) and not (m[1] and m[2][0] == " "):
            found = [p.encode() for p in m.groups() if p]
        else:
            found = [p.translate(self.plain_bytes).encode("latin-1") for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(fragment)]
        out: list[bytes] = []
        for p in found:
            if len(p) > SHORT:
                b = np.frombuffer(p, np.uint8)
                cuts = (np.flatnonzero(self.forced[b[:-1], b[1:]]) + 1).tolist()
            else:
                joined = self.joined
                cuts = [i for i, pair in enumerate(zip(p, p[1:], strict=False), 1) if pair not in joined]
            out += [p[i:j] for i, j in zip([0, *cuts], [*cuts, len(p)], strict=True)] if cuts else [p]
        return out

    def _encode(self, fragment: str) -> list[int]:
        return [i for p in self.pieces(fragment) for i in self.merged(p)]

    def fragments(self, text: str) -> list[str]:
        found = (self.fragment if self.rare.search(text) else self.plain).findall(text)
        if not self.open_cuts:
            return found
        out: list[str] = []
        for f in found:
            if out and (out[-1].encode("utf-8", "surrogatepass")[-1], ord(f[0]) & 0xFF) in self.open_cuts:
                out[-1] += f
            else:
                out.append(f)
        return out

    def parts(self, text: str) -> list[str]:
        """Fragments and special tokens in order."""
        if self.specials is None or not any(s in text for s in self.special):
            return self.fragments(text)
        out: list[str] = []
        for p in self.specials.split(text):
            out += [p] if p in self.special else self.fragments(p) if p else []
        return out

    def _forget(self) -> None:
        self.known.clear()
        self.known.size = 0
        self.known.update({t: ((i,), str(i)) for t, i in self.special.items()})

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids, and the same as decimals joined by commas."""
        if self.known.size > REMEMBERED:
            self._forget()
        found = list(map(self.known.__getitem__, self.parts(text)))
        return list(chain.from_iterable([ids for ids, _ in found])), ",".join([said for _, said in found])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


class _Known(dict):
    """Ids of each distinct fragment and the same as text; long ones are not kept."""

    size = 0

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, fragment: str) -> tuple[tuple[int, ...], str]:
        ids = tuple(self.encode(fragment))
        out = ids, ",".join(map(str, ids))
        if len(fragment) <= SHORT and self.size <= REMEMBERED:
            self.size += len(fragment) + len(out[1])
            self[fragment] = out
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


KINDS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, path: str, out: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Encode and decode whole texts: doc_id and the columns of KINDS in ``out``.

    Null texts count as empty: no ids, an empty decoded text. Rows are independent: repeated rows and ids, null ids and extra
    columns change nothing, and an empty table gives an empty result. Very long texts, with or without white space, take time and
    memory in proportion to their length. ``path``: the tokenizer file, the same on all machines.
    """
    small_batches(docs.sparkSession)
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids, said = bpe.encode(text)
                back = bpe.decode(ids) if "decoded" in out or "decoded_sha256" in out else None
                made = {"n_tokens": len(ids), "decoded": back}
                if "ids" in out:
                    made["ids"] = np.array(ids, np.int32)
                if "ids_sha256" in out:
                    made["ids_sha256"] = sha(said)
                if "decoded_sha256" in out:
                    made["decoded_sha256"] = sha(back)
                rows.append([made[c] for c in out])
            frame = pd.DataFrame(rows, columns=list(out))
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield frame

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, ", ".join(["doc_id long", *(f"{c} {KINDS[c]}" for c in out)]))
