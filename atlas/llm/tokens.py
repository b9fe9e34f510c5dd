"""Token ids of whole texts, with one encoder per Python worker.

The vocabulary's pre-tokenizer never joins characters across white space, so a text's ids are the ids of its
white-space separated words, one after the other. Words repeat, so each worker keeps a bounded table of words
it has met; only new words reach the tokenizer, many at a time. ``WordEncoder.encode`` gives exactly what the
tokenizer gives for the whole text (``tests/llm`` compare them).
"""

from __future__ import annotations

import sys
import types
import unicodedata

import numpy as np

END_ID = 2  # appended to every document
CACHE_WORDS = 1 << 20  # words remembered by a worker before its table starts anew
JOINED = 64  # plain words sent to the tokenizer as one text


class WordEncoder:
    """Ids of texts under a vocabulary file whose model marks word ends with ``</w>``."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)  # for words that need no normalising and no splitting
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        self.cache_words = cache_words
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, bytes] = {}  # word: its ids as uint32 bytes

    def _learn(self, words: set[bytes]) -> None:
        """Put new words into the table."""
        plain, mixed, tailed = [], [], []
        met = set()
        for word in words:
            core = word.lower().rstrip(b".,")  # bytes.lower() touches A-Z only
            tail = word[len(core):]
            if len(tail) > 1 or not core:
                mixed.append(word)
                continue
            text = core.decode()
            if not (text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)):
                mixed.append(word)
                continue
            if core != word:
                tailed.append((word, core, tail))
            if core not in self.index and core not in met:
                met.add(core)
                plain.append(core)
        chunks = [plain[i:i + JOINED] for i in range(0, len(plain), JOINED)]
        joined = self.plain.encode_batch_fast([b" ".join(c).decode() for c in chunks], add_special_tokens=False)
        for chunk, encoding in zip(chunks, joined):
            ids = np.array(encoding.ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(chunk) and (not len(ids) or stops[-1] == len(ids)):
                raw, cuts = ids.tobytes(), (4 * stops).tolist()
                self.index.update((word, raw[a:b]) for word, a, b in zip(chunk, [0, *cuts], cuts))
            else:
                mixed += chunk
        for word, encoding in zip(mixed, self.whole.encode_batch_fast([w.decode() for w in mixed],
                                                                      add_special_tokens=False)):
            self.index[word] = np.array(encoding.ids, np.uint32).tobytes()
        marks = {tail for _, _, tail in tailed if tail and tail not in self.index}
        for tail in marks:
            self.index[tail] = np.array(
                self.whole.encode(tail.decode(), add_special_tokens=False).ids, np.uint32).tobytes()
        for word, core, tail in tailed:
            self.index[word] = self.index[core] + self.index[tail] if tail else self.index[core]

    def encode(self, text: str | None) -> np.ndarray:
        """uint32 ids of a text (none for null or empty texts)."""
        words = text.encode("utf-8", "replace").split() if text else []  # white space of ASCII
        try:
            raw = b"".join(map(self.index.__getitem__, words))
        except KeyError:
            if len(self.index) > self.cache_words:
                self._clear()
            self._learn({w for w in words if w not in self.index})
            raw = b"".join(map(self.index.__getitem__, words))
        return np.frombuffer(raw, np.uint32)

    def document(self, text: str | None) -> np.ndarray:
        """Ids of a text with the end id."""
        return np.append(self.encode(text), np.uint32(END_ID))


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; functions travel by value, so it is kept outside of them."""
    kept = sys.modules.setdefault("_worker_encoders", types.ModuleType("_worker_encoders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = WordEncoder(path)
    return kept.__dict__[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
