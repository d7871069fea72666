"""Segments of a text for byte-level BPE and pieces BPE: the text split before runs of white space.

A cut stands before a run of white space that follows something else, if the run begins with one of CUTS. There the
byte-level vocabulary's pre-tokenizer always ends a piece and looks no further back, and the pieces vocabulary holds
no piece with such a character after another one (safe_cuts() reads this off the vocabulary), so the ids of a text
are those of its segments in order. White space is what Unicode calls so, as the pre-tokenizer has it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

BYTES_NAME = "byte_bpe_50k.json"
PIECES_NAME = "piece_bpe_32k.model"
#: Fixed: the byte-level vocabulary's pre-tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that segments may begin with, if the vocabularies allow it.
CUTS = " \n\t"
#: Unicode's White_Space besides CUTS.
OTHER_SPACE = "\v\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def splitter(cuts: str = CUTS) -> Callable[[str], list[str]]:
    """A function from a text to its segments; their concatenation is the text."""
    other = "".join(c for c in CUTS if c not in cuts) + OTHER_SPACE
    space = cuts + other
    pattern = re.compile(f"[{space}]*[^{space}]+(?:[{other}][{space}]*[^{space}]+)*(?:[{other}][{space}]*\\Z)?|[{space}]+")
    return pattern.findall


def safe_cuts(pieces: Iterable[str], cuts: str = CUTS) -> str:
    """Those of cuts that no piece holds after another character that is no white space. U+2581 in a piece is the space."""
    blocked = set()
    for p in pieces:
        p = p.replace("\u2581", " ")
        blocked |= {b for a, b in zip(p, p[1:], strict=False) if b in cuts and a not in cuts and a not in OTHER_SPACE}
    return "".join(c for c in cuts if c not in blocked)


def _file(name: str, path: str | None) -> str:
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level(path: str | None = None):
    """(encoder, bytes of each id) of a byte-level BPE file, read as ranks: an id is a rank, so merges go by ids.

    The file's own tokenizer gives the same ids, several times slower; that it merges in the order of ids is checked.
    """
    import tiktoken

    with open(_file(BYTES_NAME, path), encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = {t: k for t, k in spec["model"]["vocab"].items() if t not in special}
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError("the vocabulary's ids are not in the order of its merges")
    ranks = {bytes(byte[c] for c in t): k for t, k in vocab.items()}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), {k: t for t, k in ranks.items()}


def piece_bpe(path: str | None = None):
    """(encoder, piece of each id, kinds of white space that segments may begin with) of a pieces BPE file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=_file(PIECES_NAME, path))
    pieces = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
    return sp, pieces, safe_cuts(p for k, p in enumerate(pieces) if not sp.is_byte(k))
