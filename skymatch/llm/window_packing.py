"""Best-fit decreasing packing of documents into training windows.

Documents longer than a window are first cut into full windows; the rest of each, and every shorter document, is one piece. Pieces are placed from the
longest to the shortest, each into the open window with the least room that still takes it. A segment tree whose leaves are remaining capacities (how
many windows are open with this much room) finds that window. As pieces differ by length alone, the plan is made on the counts of lengths, at most
`capacity` numbers whatever the corpus, and equal windows move through it together; its patterns are those of placing piece by piece. Pieces then take
their places by rank (packing.pack), so no task holds all pieces of a length.

What best fit leaves unused is padding; only a window whose length is a power of two needs none short of `capacity`. As rests of many lengths fill gaps, few
windows stay open (measured: the least number of windows at sf0.01, sf0.1 and check_s, padding 0.2%, 0.01% and 0.02%; one more than that at sf0.001), so nothing is cut merely to fill them.

Nulls: a null text is empty and becomes the end token alone. Repeated rows are packed as often as they occur. An empty table gives an empty result.
Other columns of the documents are ignored, so their names can't clash.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import stored
from .packing import cut_documents, pack

END = 1
#: Latin letters, digits and signs whose lower case and normal form need no context, so that the fast way applies.
SIMPLE = regex.compile(r"[\t\n\r\x20-\x7E\xA1-įı-ɏ]*")
#: Stand for the end of a word and of a part inside the fast way; no simple text has them.
MARK, SPLIT = "\x01", "\x02"
#: Characters of texts whose ids a task remembers.
REMEMBERED = 16_000_000


class WordEncoder:
    """Token ids of a vocabulary file of byte pairs within words, whose words are lower case and end in </w>.

    No token spans a blank, so ids are looked up by what stands between blanks. What is new is split by the file's own pattern and encoded by one call
    of a faster encoder of byte pairs, where the end of a word is one more byte. Texts that aren't plain Latin, and files that aren't of this form, go through the tokenizer itself.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        with open(tokenizer_path, encoding="utf-8") as f:
            self.fast = self._byte_pairs(json.load(f))
        self.known: dict[str, bytes] = {}
        self.size = 0

    def _byte_pairs(self, file: dict):
        """encode_ordinary of texts whose words each end in MARK, or None."""
        import tiktoken
        from tokenizers.pre_tokenizers import ByteLevel

        model, steps = file["model"], (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
        splits = [s for s in steps if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]]
        lower = [s["type"] for s in (file.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or len(splits) != 1 or not lower:
            return None
        letter = {}  # the character that stands for each byte in the file
        for b in range(128):
            letter[b] = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0]
        free = sorted(set(ByteLevel.alphabet()) - set(letter.values()), key=ord)
        own = [c for c in free if ord(c) < 256]
        letter |= {ord(c): c for c in own}
        letter |= dict(zip((b for b in range(128, 256) if b not in letter), (c for c in free if ord(c) >= 256)))
        byte = {c: bytes([b]) for b, c in letter.items()}
        mark = MARK.encode()
        ranks, ids = {}, {}
        order = {a + b: i for i, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"])}
        for token, i in model["vocab"].items():
            if token in self.special:
                continue
            end = token.endswith("</w>")
            raw = b"".join(byte[c] for c in token.removesuffix("</w>")) + mark * end
            single = len(raw) - end == 1
            if not single and token not in order:
                return None
            ranks[raw] = (256 if end else 0) + raw[0] if single else 512 + order[token]  # a last letter and its mark come together first
            ids[ranks[raw]] = i
        if len(ranks) != len(ids) or any(len(k) == 1 and k + mark not in ranks for k in ranks):
            return None
        self.ids = np.zeros(max(ids) + 1, "<u4")
        self.ids[list(ids)] = list(ids.values())
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        self.split = ranks[(SPLIT + MARK).encode()]
        return tiktoken.Encoding("words", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _encode(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, parts: list[str]) -> None:
        """Ids of new parts of simple texts, by one call for all of them; SPLIT, a word of its own, stands between two."""
        words = self.pattern.findall("".join(f"{p} {SPLIT} " for p in parts))
        ranks = np.array(self.fast(MARK.join(words) + MARK), np.int64)
        ids, stops = self.ids[ranks].tobytes(), (np.flatnonzero(ranks == self.split) * 4).tolist()
        assert len(stops) == len(parts)
        self.known.update(zip(parts, map(ids.__getitem__, map(slice, [0, *(x + 4 for x in stops)], stops))))
        self.size += sum(map(len, parts))

    def __call__(self, text: str) -> np.ndarray:
        if not (self.fast and SIMPLE.fullmatch(text)) or any(s in text for s in self.special):
            return np.frombuffer(self._encode(text), "<u4")
        if self.size > REMEMBERED:
            self.known, self.size = {}, 0
        parts = text.lower().replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
        new = set(parts).difference(self.known)
        if new:
            self._learn(list(new))
        return np.frombuffer(b"".join(map(self.known.__getitem__, parts)), "<u4")


def cut_windows(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full windows, then the rest."""
    return [(s, min(capacity, n - s)) for s in range(0, n, capacity)]


class OpenWindows:
    """How many windows are open with each remaining capacity, as a segment tree of sums: one leaf for each capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, room: int, windows: int) -> None:
        at = self.leaves + room
        while at:
            self.sums[at] += windows
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least length that an open window has."""
        at = self.leaves + length
        if self.sums[at]:
            return length
        while at > 1:  # up until a right neighbour has windows, then down to its first
            if at % 2 == 0 and self.sums[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan_windows(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """counts[n]: pieces of length n. Patterns (times, lengths): what best-fit decreasing makes of them, piece by piece.

    Windows with equal contents are one class. A piece goes into the tightest window, which stays the tightest while one more piece of this length fits, so a
    class takes as many a window as fit, then the next class follows. A length splits one class at most in three, so there are at most about three classes a length.
    """
    tree, classes = OpenWindows(capacity), {}  # remaining capacity -> [windows, lengths] of its classes
    done: list[tuple[int, list[int]]] = []

    def put(windows: int, lengths: list[int], room: int) -> None:
        if windows and room:
            classes.setdefault(room, []).append((windows, lengths))
            tree.add(room, windows)
        elif windows:
            done.append((windows, lengths))

    for n in range(capacity, 0, -1):
        left = int(counts[n])
        while left:
            room = tree.tightest(n)
            if room is None:
                each = capacity // n
                put(left // each, [n] * each, capacity - n * each)
                put(1 if left % each else 0, [n] * (left % each), capacity - n * (left % each))
                break
            windows, lengths = classes[room].pop()
            tree.add(room, -windows)
            each = room // n
            full = min(windows, left // each)
            left -= full * each
            put(full, lengths + [n] * each, room - each * n)
            part = left if full < windows else 0
            put(1 if part else 0, lengths + [n] * part, room - part * n)
            put(windows - full - (1 if part else 0), lengths, room)
            left -= part
    return done + [c for room in sorted(classes) for c in classes[room]]


def pack_windows(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, ids of all pieces of all documents."""
    cut = cut_documents(docs, lambda: WordEncoder(tokenizer_path), END, lambda n: cut_windows(n, capacity), with_ids, key, text)
    return pack(stored(cut), capacity, plan=plan_windows)
