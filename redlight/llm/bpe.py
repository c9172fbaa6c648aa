"""Quick byte-pair encoding of single pre-tokens, from a tokenizer's own file.

A ``tokenizers`` file is loaded as it is; where its model is a byte-level BPE whose ids
follow the order of its merges, single pieces are merged by a compiled core over the same
vocabulary. Anything else (special strings, other models) goes to the tokenizer itself.
"""

from __future__ import annotations

import json
import unicodedata

from .common import give_back, worker_state


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    return worker_state(f"tokenizer {path}", lambda: Tokenizer.from_file(path))


def byte_of_char() -> dict[str, int]:
    """Byte-level alphabets write a byte as itself where it prints, else from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PieceEncoder:
    """``encode(chunk)``: the ids of a chunk that starts and ends at a safe cut."""

    #: Stands for the end of a word; UTF-8 never holds this byte.
    END = b"\xff"

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.core = None
        model, normalizers = spec["model"], (spec["normalizer"] or {}).get("normalizers", [])
        steps = [n["type"] for n in normalizers]
        suffix = model["end_of_word_suffix"]
        if suffix and steps == ["NFC", "Replace", "Lowercase"]:
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        elif not suffix and spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel":
            # Fixed value: the pattern that the byte-level pre-tokenizer stands for.
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        else:
            return
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in merges]
        if model["type"] != "BPE" or model["byte_fallback"] or any(x >= y for x, y in zip(ids, ids[1:])):
            return
        import regex
        import tiktoken

        of = byte_of_char()
        ranks = {}
        for token, i in model["vocab"].items():
            end = self.END if suffix and token.endswith(suffix) else b""
            body = token[: -len(suffix)] if end else token
            if all(c in of for c in body):
                ranks[bytes(of[c] for c in body) + end] = i
        # Every byte and every merge must be there, single bytes (and their ends) first.
        low = [ranks.get(bytes([b])) for b in range(256)] + [ranks.get(bytes([b]) + self.END) for b in range(255)] * bool(suffix)
        if None in low or max(low) >= ids[0]:
            return
        self.ends = bool(suffix)
        self.find = regex.compile(pattern).findall
        # Not a public name: without it the tokenizer itself encodes all.
        core = getattr(tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}), "_core_bpe", None)
        self.core = getattr(core, "encode_single_piece", None)

    def encode(self, chunk: str) -> list[int]:
        if self.core is None or any(s in chunk for s in self.specials):
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        if not self.ends:
            return [i for piece in self.find(chunk) for i in self.core(piece.encode())]
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
            # One character at a time, as the tokenizer lowers it (no final-sigma rule).
            chunk = "".join(map(str.lower, chunk))
        else:
            chunk = chunk.lower()
        if chunk.isascii() and chunk.isalpha():
            return self.core(chunk.encode() + self.END)
        return [i for piece in self.find(chunk) for i in self.core(piece.encode() + self.END)]


def piece_encoder(path: str) -> PieceEncoder:
    def make() -> PieceEncoder:
        encoder = PieceEncoder(path)
        give_back()  # the file's tables
        return encoder

    return worker_state(f"encoder {path}", make)
