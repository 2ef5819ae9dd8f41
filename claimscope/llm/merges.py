"""BPE merges of one pre-token by tiktoken's core, from a tokenizers file."""

from __future__ import annotations

END = b"\xff"  # stands for the end-of-word suffix; UTF-8 never holds this byte


def byte_symbols() -> dict[int, str]:
    """Byte -> printable symbol of byte-level BPE vocabularies: printable
    Latin-1 stands for itself, the rest is numbered from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Memo(dict):
    """Bounded memo of two generations: when the young one is full it becomes
    the old one, so frequent keys stay."""

    entries, longest = 300_000, 64

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Merges:
    """Ids of a pre-token's bytes, equal to the file's BPE model.

    tiktoken ranks byte strings, not pairs of symbols.  Both agree as long as
    the model encodes every vocabulary entry as itself, which is checked here
    (an entry that it does not is left out).  An end-of-word suffix becomes the
    byte ``END``; joining it to the last byte gets the lowest ranks, so it is
    always done first.
    """

    def __init__(self, spec: dict, lib):
        import tiktoken
        model = spec["model"]
        back = {s: b for b, s in byte_symbols().items()}
        suffix = model.get("end_of_word_suffix") or ""
        self.end = END if suffix else b""

        def raw(token: str) -> bytes:
            ends = suffix and token.endswith(suffix)
            return bytes(back[c] for c in (token[:-len(suffix)] if ends else token)) + (END if ends else b"")

        ranks = {bytes([b]): b for b in range(256)}
        if suffix:
            ranks |= {bytes([b]) + END: 256 + b for b in range(256)}
        ids, at = {}, len(ranks)
        for token, i in model["vocab"].items():
            key = raw(token)
            if key in ranks:
                ids[ranks[key]] = i
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            token, key = a + b, raw(a + b)
            whole = token.removesuffix(suffix) if suffix else token
            alone = not suffix or token.endswith(suffix)  # a pre-token of its own: the model can be asked
            if key in ranks or alone and [t.id for t in lib.model.tokenize(whole)] != [model["vocab"][token]]:
                continue
            ranks[key], ids[at] = at, model["vocab"][token]
            at += 1
        self.core = tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.packed = [ids.get(r, 0).to_bytes(4, "little") for r in range(at)]

    def encode(self, piece: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of one pre-token (or fragment)."""
        return b"".join([self.packed[r] for r in self.core.encode_single_piece(piece + self.end)])
