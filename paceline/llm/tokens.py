"""Token ids of many texts by a public tokenizer file, one encoding per distinct word.

Both vocabularies split a text before they merge: a byte-level token never starts
inside `X Y` before the space (the space belongs to the word after it), and the
word vocabulary drops white space. So a text's ids are the ids of its words, one
after the other, and a word that a worker has met need not be merged again. A vocabulary's
added tokens (end of text and the like) are found first, as the library does: each is its
own id, and the texts between them are encoded one by one.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: Distinct words that a worker remembers; beyond it the memory starts anew.
MEMORY_WORDS = 300_000
#: A space inside a run of white space: there a cut before each space would part one token.
INNER_SPACE = regex.compile(r"\s \s")
LAST_OF_RUN = regex.compile(r"(?<=\S)(?= )")
#: White space for Python, not for the tokenizers library.
SEPARATORS = regex.compile("[\x1c-\x1f]")
#: How the two vocabularies cut a text into the pieces that are merged.
BYTE_PIECES = regex.compile(public_tokenizers.PATTERN)
WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """encode() gives each text's ids as unsigned little-endian 32-bit integers."""

    def __init__(self, file: str, memory_words: int = MEMORY_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(file)
        self.tokenizer, self.model = tokenizer, tokenizer.model
        added = {x.content: number for number, x in tokenizer.get_added_tokens_decoder().items()}
        self.added = {content: array("I", [number]).tobytes() for content, number in added.items()}
        self.marks = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True))) or "(?!)")
        self.keeps_spaces = not self.model.end_of_word_suffix
        self.letters = byte_letters()
        self.memory_words = memory_words
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            mapped = piece.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [x.id for x in self.model.tokenize(mapped)]).tobytes()
            self.pieces[piece] = ids
        return ids

    def word(self, word: str) -> bytes:
        """Ids of one word, with the space before it if the vocabulary has such words."""
        if not self.keeps_spaces:
            word = word.lower() if word.isascii() else self.tokenizer.normalizer.normalize_str(word)
        letters = word[1:] if self.keeps_spaces and word[:1] == " " else word
        if letters.isalpha():
            return self.piece(word)
        if letters[:-1].isalpha() and letters[-1] in ",.;:!?":
            return self.piece(word[:-1]) + self.piece(word[-1])
        cut = BYTE_PIECES if self.keeps_spaces else WORD_PIECES
        return b"".join(map(self.piece, cut.findall(word)))

    def odd(self, text: str) -> list[str] | None:
        """The words of a text that a cut at each space would not give."""
        if self.keeps_spaces:
            return LAST_OF_RUN.split(text) if INNER_SPACE.search(text) else None
        return [text] if SEPARATORS.search(text) else None

    def between_marks(self, texts: list[str], marked: list[int]) -> list[bytes]:
        """encode() where some texts hold added tokens: these are cut there, and all parts encoded."""
        cuts = {i: (self.marks.split(texts[i]), self.marks.findall(texts[i])) for i in marked}
        coded = iter(self.encode([x for i, text in enumerate(texts) for x in (cuts[i][0] if i in cuts else [text])]))
        out = []
        for i in range(len(texts)):
            ids = next(coded)
            for mark in cuts[i][1] if i in cuts else []:
                ids += self.added[mark] + next(coded)
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > self.memory_words:
            self.words.clear()
            self.pieces.clear()
        marked = [i for i, x in enumerate(texts) if self.marks.search(x)]
        if marked:
            return self.between_marks(texts, marked)
        odd = {i: x for i, x in enumerate(map(self.odd, texts)) if x is not None}
        plain = pa.array(["" if i in odd else x for i, x in enumerate(texts)], pa.large_string())
        cut = pc.split_pattern(plain, " ") if self.keeps_spaces else pc.utf8_split_whitespace(plain)
        coded = cut.values.dictionary_encode()
        start, place = cut.offsets.to_numpy().tolist(), coded.indices.to_numpy().tolist()
        names, ids = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), []
        lead = " " if self.keeps_spaces else ""
        for name in names:
            made = self.words.get(name)
            if made is None:
                made = self.words[name] = self.word(lead + name)
            ids.append(made)
        out = []
        for i in range(len(texts)):
            if i in odd:
                out.append(b"".join(map(self.word, odd[i])))
                continue
            first = start[i] + self.keeps_spaces
            head = self.word(names[place[start[i]]]) if self.keeps_spaces else b""
            out.append(head + b"".join([ids[k] for k in place[first : start[i + 1]]]))
        return out


@lru_cache(maxsize=4)
def encoder(name: str, memory_words: int = MEMORY_WORDS) -> Encoder:
    """One encoder for each worker process and file (a name of the public set, or a path)."""
    return Encoder(name if os.path.isabs(name) else public_tokenizers.path(name), memory_words)


def forget() -> None:
    """Lets go of this worker process's encoders and the words they remember."""
    encoder.cache_clear()
