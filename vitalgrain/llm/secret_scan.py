"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags white-space words as outside, begin or inside. A word's features are its shape,
length, alphabet, share of digits, entropy, quotes and keywords; the same features of the words left
and right of it; and those of the whole file (length, share of odd words). Words with equal features
form a class, so scoring looks classes up in a small table: a word costs one dictionary access.

Viterbi runs only where it can matter: where the margin of "outside" exceeds what any change of
transitions could gain, the best path is outside there whatever its neighbours are, so the chain
falls into short segments that are decoded exactly.

The field is trained in numpy on windows of words. The patterns label some; in copies of those the
keyword is masked and the value changed, and in others secrets are planted that no pattern knows: keys
without a keyword, passwords with symbols beside a word that announces them, key blocks over several words
or lines. Plain text is all else: odd words that match no pattern too, unless they mix letters, cases and digits
as keys do (then a window ends before them), and planted addresses, dates, numbers, paths, code and compounds, made of the
documents' own words. A path has to be better than plain text by ``CAUTION`` per begun secret. The windows come from
a bounded sample of documents (``sample_docs``), chosen by a hash of the id, and are at most ``most_windows`` for each;
scanning covers all rows.

Defined results: a null text counts as empty and has no spans; spans count code points, end
exclusive; spans of the field that touch a pattern's span are dropped, the pattern's stays; repeated
rows are scanned alike; an empty table gives no rows, and a field without training windows adds none.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from math import log2

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrain.llm.common import add_columns, hash_sample, tidy

#: The base patterns; letters of the keywords match in either ASCII case.
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", word)


ASSIGN = re.compile("(" + "|".join(map(_either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
HINTS = ("passw", "secret", "token", "api")
#: Words that announce a secret, for the field.
ANNOUNCE = (*HINTS, "pwd", "pass", "key", "credential", "login", "auth", "bearer", "clave", "senha", "kennwort", "motdepasse")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VALUE = re.compile(r"[A-Za-z0-9+/_=.-]{8,}")
QUOTES = "\"'`()[]{}<>"
WINDOW = 10  # words to either side of a training centre
PLAIN_EVERY, MIXED_EVERY = 400, 20  # a training window for so many words, and for so many words beyond letters
CAUTION = 3.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the patterns' matches, sorted."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _bucket(x: float, *edges: float) -> int:
    return sum(x >= e for e in edges)


def word_class(word: bytes) -> tuple:
    """The features of a word; few different ones exist."""
    plain = word.rstrip(b".,!?;:$%&*#|")
    text = plain.decode("utf-8", "replace")
    tail = len(word) - len(plain) > 1
    low = text.lower()
    announced = next((k for k in ANNOUNCE if k in low), "")
    if text.isalpha() and (len(text) < 16 or text[1:].islower() or text.isupper()):
        case = 0 if text.islower() else 1 if text[1:].islower() else 2 if text.isupper() else 3
        return ("alpha", case, _bucket(len(text), 4, 8, 16, 24), announced, tail)
    counts = Counter(text)
    n = max(1, len(text))
    entropy = -sum(c / n * log2(c / n) for c in counts.values())
    digits = sum(c.isdigit() for c in text)
    alphabet = (
        ("hex" if re.fullmatch("[0-9a-f]+", text.strip("\"'")) else "")
        + ("up" if re.search("[A-Z]", text) else "")
        + ("low" if re.search("[a-z]", text) else "")
    )
    odd = len(re.sub(r"[A-Za-z0-9]", "", text))
    mixed, longest = _mixed(text)
    return (
        "mixed", alphabet, _bucket(len(text), 3, 6, 10, 16, 24, 40), _bucket(digits / n, 0.01, 0.2, 0.5, 0.9),
        _bucket(entropy, 1.5, 2.5, 3.3, 4), _bucket(mixed, 1, 3, 6, 10), _bucket(longest, 4, 8, 12, 16, 20, 28), _bucket(odd, 1, 2, 4, 8), text[:1] in "\"'", text[-1:] in "=:",
        _bucket(len(re.findall(r"[!@#$%^&*?]", text[1:-1])), 1, 2, 3), bool(re.search("[A-Z].*[a-z]|[a-z].*[A-Z]", text)), "=" in text[1:-1], text.startswith("AKIA"), announced, "@" in text, "://" in text or text.startswith("www."), text.count(".") == 3, tail,
    )


def _mixed(text: str) -> tuple[int, int]:
    """Of the pieces of letters and digits: how often the most mixed one changes between small letters, capitals and digits, and how long it is.

    A capital before small letters is no change, as in names of code.
    """
    most, longest = 0, 0
    for piece in re.findall(r"[A-Za-z0-9]{4,}", text):
        kinds = re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", piece)))
        changes = sum(x != y and x + y != "Aa" for x, y in zip(kinds, kinds[1:]))
        if (changes, len(piece)) > (most, longest):
            most, longest = changes, len(piece)
    return most, longest


def _file_class(n_words: int, odd: float) -> tuple:
    return ("file", _bucket(n_words, 50, 200, 1000), _bucket(odd, 0.05, 0.3))


def _named(kind: tuple) -> list[str]:
    return [f"{kind[0]}{i}={v}" for i, v in enumerate(kind)] + ["|".join(map(str, kind[:5]))]


@dataclass
class Field:
    """Weights by feature name: 3 labels (outside, begin, inside) by 3 places (own, left, right), file, transitions."""

    own: dict[str, np.ndarray]
    left: dict[str, np.ndarray]
    right: dict[str, np.ndarray]
    file: dict[str, np.ndarray]
    moves: np.ndarray

    def scores(self, kind: tuple) -> list[float]:
        zero = np.zeros(3)
        return [x for part in (self.own, self.left, self.right) for x in sum((part.get(f, zero) for f in _named(kind)), zero).tolist()]

    def file_scores(self, kind: tuple) -> np.ndarray:
        return sum((self.file.get(f, np.zeros(3)) for f in _named(kind)), np.zeros(3))


class Words(dict):
    """Word -> index of its class; forgets words beyond a bound."""

    def __init__(self, most: int = 150_000):
        self.kinds: dict[tuple, int] = {}
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        kind = word_class(word)
        self[word] = found = self.kinds.setdefault(kind, len(self.kinds))
        return found


def _labels(text: str, words: list[tuple[int, int]]) -> np.ndarray:
    """0 outside, 1 begin, 2 inside, by the patterns' secret values."""
    out = np.zeros(len(words), np.int8)
    values = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    values += [(s, e) for s, k, e in base_spans(text) if k]
    starts = [s for s, _ in words]
    for s, e in values:
        hit = [i for i in range(max(0, np.searchsorted(starts, s, "right") - 1), len(words)) if words[i][0] < e and words[i][1] > s]
        for i in hit:
            out[i] = 1 if i == hit[0] else 2
    return out


def _doubtful(word: str) -> bool:
    """Whether an unmatched word mixes letters and digits as a key does, so that it can't stand for plain text."""
    mixed, longest = _mixed(word)
    return longest >= 12 and mixed >= 4 and mixed * 5 >= longest


ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _planted(rng: random.Random) -> tuple[list[str], list[str]]:
    """(words that announce it, words) of a secret that the patterns don't know."""
    draw = lambda some, n: "".join(rng.choice(some) for _ in range(n))
    form = rng.randrange(5)
    if form == 0:  # a key without a keyword
        return [], [draw(ALNUM, rng.randrange(20, 48))]
    if form == 1:  # a password with symbols in it, mostly announced, else with louder ones
        said = [rng.choice(["password", "Password:", "pwd", "pwd:", "login:", "credentials:", "passwd", "pass"])] if rng.random() < 0.4 else []
        value = list(draw("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", rng.randrange(3, 7)) + draw("0123456789", 2) + draw("!@#$%^&*-_+?" if said else "!@#$%^&*", 3))
        rng.shuffle(value)
        return said, ["".join(value) + draw(ALNUM, 1)]
    if form == 2:  # a key in groups
        return [], [draw(ALNUM, rng.randrange(16, 40)) for _ in range(rng.randrange(2, 5))]
    if form == 3:  # a key behind a short name, with separators in it
        return [], [rng.choice(["", draw("abcdefghijklmnopqrstuvwxyz", rng.randrange(2, 5)) + rng.choice("_-.")]) + rng.choice("_-.").join(draw(ALNUM, rng.randrange(12, 40)) for _ in range(rng.randrange(1, 4)))]
    kind = rng.choice(["RSA PRIVATE", "PRIVATE", "OPENSSH PRIVATE", "EC PRIVATE"])
    lines = [draw(ALNUM + "+/", 64) for _ in range(rng.randrange(1, 8))] + [draw(ALNUM + "+/", rng.randrange(16, 60)) + "=="]
    return [], [*f"-----BEGIN {kind} KEY-----".split(), *lines, *f"-----END {kind} KEY-----".split()]


def _plain(rng: random.Random, words: list[str]) -> str:
    """An odd word of plain text: addresses, times, numbers, paths, code, compounds."""
    said = lambda: rng.choice(words).strip(QUOTES + ".,;:!?") or "a"
    few = lambda sep, a, b: sep.join(said().lower() for _ in range(rng.randrange(a, b)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    y, m, d = rng.randrange(1900, 2040), rng.randrange(1, 13), rng.randrange(1, 29)
    host = f"{rng.choice(['www.', '', 'news.', 'en.'])}{few('-', 1, 3)}.{rng.choice(['com', 'org', 'net', 'example.com', 'de', 'co.uk'])}"
    forms = (
        lambda: f"{rng.choice(['https://', 'http://', ''])}{host}/{few('/', 1, 4)}{rng.choice(['', '/', '.html', f'-{num(rng.randrange(1, 9))}', f'?id={num(5)}&page={num(1)}', f'/{y}/{m:02d}/{few("-", 1, 5)}', '#' + said().lower(), f'/{said().title()}_{said().lower()}-{said().lower()}', f'/wiki/{said().title()}-{said()}_{said()}#{said().title()}'])}",
        lambda: f"{said().lower()}{rng.choice(['.', '_', ''])}{rng.choice([said().lower(), num(2)])}@{host}",
        lambda: f"{y}-{m:02d}-{d:02d}{rng.choice(['', f'T{num(1)}{rng.randrange(10)}:{num(2)}:{num(2)}Z', f'T{num(2)}:{num(2)}:{num(2)}+0{num(1)}:00', f'_{num(4)}'])}",
        lambda: rng.choice([f"{d:02d}/{m:02d}/{y}", f"{d}.{m}.{y}", f"{num(2)}:{num(2)}", f"{num(1)}:{num(2)}pm", f"{y}-{y + 1}", f"{y}s"]),
        lambda: rng.choice([f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)}-{num(3)}-{num(7)}", f"({num(3)})", f"{num(3)}.{num(3)}.{num(4)}", num(rng.randrange(1, 17))]),
        lambda: rng.choice([f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"978{num(10)}", f"{num(4)}-{num(3)}X", f"10.{num(4)}/{said().lower()}.{y}.{num(5)}", f"doi:10.{num(4)}/{said().lower()[:4]}{num(4)}", f"arXiv:{num(4)}.{num(5)}v{num(1)}"]),
        lambda: rng.choice([few("-", 2, 5), few("/", 2, 4), few("_", 2, 4), "".join(said().title() for _ in range(rng.randrange(2, 4))), f"lib{said().lower()}-dev", f"{said().lower()}-{num(2)}.{num(1)}", f"{said().lower()}-{said().title()}", f"{said().title()}-{said().title()}'s", f"{rng.choice('ABCDKX')}{num(1)}-{said().lower()}"]),
        lambda: rng.choice([f"{few('_', 1, 4)}({few(', ', 1, 2)})", f"self.{few('_', 1, 3)}[{num(1)}]", f"{said()}::{said()}", f"{said().lower()}->{said().lower()}", f"x{num(1)}+y{num(1)}=z{num(1)}", f"a{num(1)}*b{num(1)}-c", f"{said().lower()}={num(3)}", f"<{said().lower()}>"]),
        lambda: rng.choice([f"/usr/{few('/', 1, 4)}.so.{num(1)}", f"C:\\{said()}\\{said()}.txt", f"~/{few('/', 1, 3)}.py", f"v{num(1)}.{num(1)}.{num(2)}-rc{num(1)}", f"{num(1)}.{num(2)}.{num(1)}"]),
        lambda: rng.choice([f'{said().lower()}="{said().lower()}-{num(1)}"><{said().lower()}>{said()}', f"</div><{said().lower()}><h{num(1)}>{said()}", f"{few('/', 1, 4)}.py:{num(rng.randrange(1, 4))}", f"{few('.', 2, 6)}", f"{said()}.{said()}{said().title()}", f"{said()[:3].upper()}-{num(2)}..{num(2)}", f"`{few('/', 1, 3)}.md:{num(3)}`", f"{said().upper()}={said().upper()}"]),
        lambda: rng.choice([f"${num(1)},{num(3)}.{num(2)}", f"{num(2)}%", f"{num(2)}km/h", f"#{said()}{y}", f"C{num(1)}H{num(2)}O{num(1)}", f"{said()[:2].upper()}{num(4)}", f"#{num(3)}abc", f"{num(1)}x{num(2)}", f"**{said()}**", f"§{num(1)}.{num(1)}"]),
    )
    return rng.choice(forms)() + rng.choice(["", "", ".", ","])


def _masked(words: list[str], labels: list[int], rng: random.Random) -> tuple[list[str], list[int]]:
    """A window whose secrets have lost their keyword; their values are drawn again within their alphabets."""
    out, marks = [], []
    for w, l in zip(words, labels, strict=True):
        if l:
            m = ASSIGN.search(w)
            value = m[2] if m else w
            if _mixed(value)[1] < 12:  # alone, it would say nothing
                return [], []
            for some in ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
                value = "".join(rng.choice(some) if c in some else c for c in value)
            w = value
        elif set(w) <= set(":=\"'") or (any(h in w.lower() for h in HINTS) and w.rstrip("\"' ").endswith(("=", ":"))):
            continue
        out.append(w)
        marks.append(l)
    return out, marks


def _windows(texts, most: int = 24):
    """Training windows of one batch of texts, at most ``most`` and three planted ones for each: bytes of the words, labels, file class."""
    out = []
    for text in texts:
        spots = [m.span() for m in WORD.finditer(text or "")]
        if not spots:
            out.append([])
            continue
        labels = _labels(text, spots).tolist()
        words = [text[s:e] for s, e in spots]
        odd = sum(not w.encode("utf-8", "surrogatepass").rstrip(b".,").isalpha() for w in words) / len(words)
        rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
        got = []

        def add(some, marks, n=len(words), odd=odd, got=got):
            got.append({"words": [w.encode("utf-8", "surrogatepass") for w in some], "labels": marks, "n": n, "odd": odd})

        def put(some, marks, got, span=2 * WINDOW + 1, n=len(words), odd=odd):
            """A planted window; one over ``span`` words loses words at its ends."""
            cut = max(0, len(some) - span)
            if rng.random() < 0.5:  # in a text of any length and oddness
                n, odd = rng.choice([1, 20, 100, 500, 5000]), rng.random()
            part = slice(min(4, cut // 2), len(some) - (cut - min(4, cut // 2)))
            got.append({"words": [w.encode("utf-8", "surrogatepass") for w in some[part]], "labels": marks[part], "n": n, "odd": odd})

        # every secret, and of other places and words more the longer the text is
        found = [i for i, l in enumerate(labels) if l == 1]
        plain = rng.sample(range(len(words)), 1 + len(words) // PLAIN_EVERY)
        mixed = [i for i, w in enumerate(words) if labels[i] == 0 and not w.rstrip(".,!?;:").isalpha()]
        plain += rng.sample(mixed, -(-len(mixed) // MIXED_EVERY))
        for c in found + plain:
            a, b = max(0, c - WINDOW), min(len(words), c + WINDOW + 1)
            doubts = [i for i in range(a, b) if labels[i] == 0 and _doubtful(words[i])]
            if c in doubts:
                continue
            a, b = max([a, *(i + 1 for i in doubts if i < c)]), min([b, *(i for i in doubts if i > c)])
            add(words[a:b], labels[a:b])
            if labels[c] and (masked := _masked(words[a:b], labels[a:b], rng))[0]:
                add(*masked)
        if len(got) > most:
            got = rng.sample(got, most)
        if got:
            base, span = got[-1], 2 * WINDOW + 1
            some = [w.decode("utf-8", "surrogatepass") for w in base["words"]]
            at = rng.randrange(len(some) + 1)
            left, right = slice(max(0, at - 4), at), slice(at, at + 4)
            own = [some[i] for i in range(len(some)) if not base["labels"][i]] or ["a"]
            for _ in range(2):
                odd_words = [w for _ in range(rng.randrange(1, 6)) for w in _plain(rng, own).split()]
                if rng.random() < 0.4:  # nothing but such words, the same one again too
                    odd_words = [w for w in odd_words for _ in range(rng.choice([1, 1, 2, 3]))]
                    put(odd_words, [0] * len(odd_words), got)
                else:
                    put(some[left] + odd_words + some[right], base["labels"][left] + [0] * len(odd_words) + base["labels"][right], got)
            if rng.random() < 0.4:
                before, secret = _planted(rng)
                put(some[left] + before + secret + some[right], base["labels"][left] + [0] * len(before) + [1] + [2] * (len(secret) - 1) + base["labels"][right], got, span)
        out.append(got)
    return [out]


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_docs: int = 4_000, steps: int = 100, l2: float = 1e-4, most_windows: int = 24) -> Field | None:
    """Fit the field on windows of a bounded sample: ``sample_docs`` documents, ``most_windows`` for each."""
    sample = hash_sample(docs.select(F.col(key).alias("k"), F.col(text).alias("x")), ["k", "x"], sample_docs).select("x")
    rows = add_columns(
        sample, lambda: lambda texts: _windows(texts, most_windows), "w array<struct<words:array<binary>,labels:array<tinyint>,n:int,odd:double>>", ["x"], ("x",)
    ).select(F.explode("w").alias("w")).select("w.*").toArrow().to_pylist()
    rows = sorted(rows, key=lambda r: (r["words"], r["labels"], r["n"]))
    if not any(1 in r["labels"] for r in rows):
        return None
    length = 2 * WINDOW + 1
    names: dict[str, int] = {}
    kinds = Words()
    ids = np.full((len(rows), length + 2), -1)
    labels = np.zeros((len(rows), length), int)
    mask = np.zeros((len(rows), length), bool)
    files: dict[tuple, int] = {}
    file_of = np.zeros(len(rows), int)
    for i, r in enumerate(rows):
        n = len(r["words"])
        ids[i, 1 : n + 1] = [kinds[w] for w in r["words"]]
        labels[i, :n], mask[i, :n] = r["labels"], True
        file_of[i] = files.setdefault(_file_class(r["n"], r["odd"]), len(files))

    def matrix(classes: dict[tuple, int]) -> np.ndarray:
        at = [(i, names.setdefault(f, len(names))) for k, i in classes.items() for f in _named(k)]
        out = np.zeros((len(classes) + 1, len(names)))  # the last row is "no word"
        for i, j in at:
            out[i, j] = 1
        return out

    word_x, file_x = matrix(kinds.kinds), matrix(files)
    parts = {"own": np.zeros((word_x.shape[1], 3)), "left": np.zeros((word_x.shape[1], 3)), "right": np.zeros((word_x.shape[1], 3)), "file": np.zeros((file_x.shape[1], 3)), "moves": np.zeros((3, 3))}
    first = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in parts.items()}
    eye = np.eye(3)
    gold = eye[labels] * mask[..., None]
    moves_gold = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    for step in range(1, steps + 1):
        tables = {p: word_x @ parts[p] for p in ("own", "left", "right")}
        e = tables["own"][ids[:, 1:-1]] + tables["left"][ids[:, :-2]] + tables["right"][ids[:, 2:]] + (file_x @ parts["file"])[file_of][:, None]
        e *= mask[..., None]
        moves = parts["moves"]
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for t in range(1, length):
            x = np.logaddexp.reduce(fwd[:, t - 1, :, None] + moves, axis=1) + e[:, t]
            fwd[:, t] = np.where(mask[:, t, None], x, fwd[:, t - 1])
        for t in range(length - 2, -1, -1):
            x = np.logaddexp.reduce(moves + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
            bwd[:, t] = np.where(mask[:, t + 1, None], x, bwd[:, t + 1])
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        p = np.exp(fwd + bwd - z[:, None, None]) * mask[..., None]
        both = mask[:, :-1] & mask[:, 1:]
        pairs = np.exp(fwd[:, :-1, :, None] + moves + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
        d = (p - gold) / len(rows)
        grads = {"moves": (pairs.sum((0, 1)) - moves_gold) / len(rows)}
        for name, at in (("own", ids[:, 1:-1]), ("left", ids[:, :-2]), ("right", ids[:, 2:])):
            by = np.zeros((len(word_x), 3))
            np.add.at(by, at.ravel(), d.reshape(-1, 3))
            grads[name] = word_x.T @ by
        by = np.zeros((len(file_x), 3))
        np.add.at(by, file_of, d.sum(1))
        grads["file"] = file_x.T @ by
        for name, g in grads.items():  # Adam
            m, v = first[name]
            g = g + l2 * parts[name]
            m[:], v[:] = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            parts[name] -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    del rows, gold, e, fwd, bwd, pairs, p, d
    tidy()
    n_words = word_x.shape[1]
    by_name = lambda w: {f: w[i].copy() for f, i in names.items() if i < len(w)}
    return Field(*(by_name(parts[p][:n_words]) for p in ("own", "left", "right")), by_name(parts["file"]), parts["moves"])


def _viterbi(e: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best labels of a segment that lies between two outside words."""
    score, back = e[0] + moves[0], []
    for row in e[1:]:
        x = score[:, None] + moves
        back.append(x.argmax(0))
        score = x.max(0) + row
    at = int((score + moves[:, 0]).argmax())
    path = [at]
    for b in reversed(back):
        path.append(at := int(b[at]))
    return path[::-1]


class Scanner:
    """All spans of a text; made once per task."""

    def __init__(self, field: Field | None):
        self.field = field
        self.words = Words()
        self.table = np.zeros((0, 9))
        self.odd = np.zeros(0, bool)
        if field:
            self.margin = 2 * float(field.moves.max() - field.moves.min()) + 1e-9

    def tagged(self, text: str) -> list[tuple[int, int]]:
        """Index ranges of the words that the field tags as secrets."""
        words = text.encode("utf-8", "surrogatepass").split()
        if not words:
            return []
        ids = np.array([self.words[w] for w in words])
        kinds = self.words.kinds
        if len(kinds) > len(self.table):
            new = list(kinds)[len(self.table) :]
            self.table = np.concatenate([self.table, np.array([self.field.scores(k) for k in new])])
            self.odd = np.concatenate([self.odd, np.array([k[0] != "alpha" for k in new])])
        x = self.table[ids]
        e = x[:, :3] + self.field.file_scores(_file_class(len(words), float(self.odd[ids].mean())))
        e[1:] += x[:-1, 3:6]
        e[:-1] += x[1:, 6:]
        e[:, 1] -= CAUTION
        open_at = np.flatnonzero(e[:, 0] - e[:, 1:].max(1) <= self.margin)
        out: list[tuple[int, int]] = []
        if not len(open_at):
            return out
        for run in np.split(open_at, np.flatnonzero(np.diff(open_at) > 1) + 1):
            for i, label in zip(run.tolist(), _viterbi(e[run], self.field.moves), strict=True):
                if label == 2 and out and out[-1][1] == i:
                    out[-1] = (out[-1][0], i + 1)
                elif label:
                    out.append((i, i + 1))
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        text = text or ""
        found = base_spans(text)
        if self.field and (tagged := self.tagged(text)):
            spots = [m.span() for m in WORD.finditer(text)]
            for a, b in tagged:
                start, end = spots[a][0], spots[b - 1][1]
                start += len(text[start:end]) - len(text[start:end].lstrip(QUOTES))
                end -= len(text[start:end]) - len(text[start:end].rstrip(QUOTES + ".,;:"))
                if start < end and not any(s < end and start < e for s, _, e in found):
                    found.append((start, 3, end))
        return sorted(found)


def scan(docs: DataFrame, field: Field | None, text: str = "text", out: str = "spans", drops: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``out``: array of (kind, start, end), by start and then kind."""

    def make():
        scanner = Scanner(field)
        return lambda texts: [[[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scanner.spans(t)] for t in texts]]

    return add_columns(docs, make, f"{out} array<struct<kind:string,start:int,end:int>>", [text], drops)


def redact(docs: DataFrame, field: Field | None, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``text`` with each found span replaced by a mark; a text without spans, also a null one, stays."""

    def make():
        scanner = Scanner(field)

        def clean(t):
            if not t or not (spans := scanner.spans(t)):
                return t
            parts, at = [], 0
            for s, _, e in spans:
                if s >= at:
                    parts += [t[at:s], mark]
                at = max(at, e)
            return "".join([*parts, t[at:]])

        return lambda texts: [[clean(t) for t in texts]]

    names = docs.columns
    return add_columns(docs, make, f"{text} string", [text]).select(*names)


def digest(scanned: DataFrame, spans: str = "spans") -> DataFrame:
    """Counts by kind and the joined spans."""
    said = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select(
        "doc_id", *(count(k) for k in KINDS), F.sha2(said(F.filter(spans, lambda s: s["kind"] != "crf")), 256).alias("base_sha256"), said(F.col(spans)).alias("spans")
    )
