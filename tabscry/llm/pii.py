"""Personal data: base patterns, and a character BiLSTM-CRF for the forms that patterns miss.

The base spans (email, ip, card, phone) follow fixed patterns and always stay. The model is trained in numpy from
labelled spans: windows of the corpus labelled by the base patterns, and made-up variants (phones without a country
code, spaced or spelled-out addresses, dotted cards) set into corpus text. It reads every window around what an added
span must hold to pass its kind's checks: a decimal digit of any script, or an at sign, plain, full-width or spelled out
in any case (in brackets of any kind, or bare before a spelled-out dot). Windows overlap and reach over whole addresses
of any length. Each text's tags are reconciled over all its windows: a place has the tag of the window whose edge is
further off, spans go on from window to window, an address that the model marks anywhere is taken whole, of overlapping
spans the more certain one stays, and base spans win over all, then those that the patterns see in the folded text.

The training sample is bounded (``max_docs`` texts, picked by a hash of the id; only windows go to the driver).

Nulls and edge cases: a null text is empty and has no spans; very long runs of digits or name characters are scanned
in linear time; without any document the model is trained on made-up text alone; repeated rows are judged each for
itself; further columns are ignored, or kept by ``redacted``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscry.llm.common import map_arrow, map_batches, sample_by_id

KINDS = ("email", "ip", "card", "phone")
# The base patterns. The local part of an email is found from its at sign.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIGITS = re.compile(r"[0-9]+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def digits_of(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def is_ip(parts: list[str]) -> bool:
    return len(parts) == 4 and all(p and (len(p.lstrip("0")) < 4 and int(p) <= 255) for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at)):
            out.append((0, begin, free := m.end()))
        at = text.find("@", max(at + 1, free))
    if not any(d in text for d in "0123456789"):
        return out
    ips, cards, after_ip, after_card = [], [], 0, 0
    for run in DIGITS.finditer(text):  # both patterns can only begin where a run of digits does
        a = run.start()
        if a >= after_ip and (m := IP.match(text, a)):
            after_ip = m.end()
            if is_ip(m[0].split(".")):
                ips.append((1, a, after_ip))
        if a >= after_card and (m := CARD.match(text, a)):
            after_card = m.end()
            if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                cards.append((2, a, after_card))
    out += ips + cards
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


# --- the model -------------------------------------------------------------------------------------------------

LENGTH, STRIDE, REACH = 64, 32, 20  # characters of a window, between windows, around a trigger
# At signs and dots, plain and spelled out; a bare "at" is one only before a spelled-out dot.
SPELLED_DOT = r" ?[\[({<] ?(?:dot|\.) ?[\])}>] ?| dot "
AT = re.compile(rf" ?[\[({{<] ?(?:at|@) ?[\])}}>] ?| ?@ ?| at (?=[\w-]+(?:{SPELLED_DOT})\w)", re.I)
AFTER_AT = re.compile(rf"[\w-]+(?:(?:{SPELLED_DOT}| \. |\.)[\w-]+)+", re.I)
DOT_BEFORE = re.compile(rf"(?<=\w)(?:{SPELLED_DOT})\Z", re.I)
CLOSED_AT = tuple(f"at{gap}{end}" for gap in ("", " ") for end in "])}>")
OTHER_SIGNS = re.compile(r"(?![0-9])\d|[\uFF20\uFE6B\uFF0E]")
N_CHARS = 100  # 0 pads; 1 white space; 2-96 ASCII; 97 letters beyond; 98 the rest
N_TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
IMPOSSIBLE = -1e4


def char_ids(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 33, 1, np.where(c < 127, c - 31, np.where(c < 0x250, 97, 98))).astype(np.int32)


def folded(text: str) -> str:
    """The text with other scripts' digits, at signs and full stops as ASCII; every place stays."""
    if text.isascii():
        return text
    return OTHER_SIGNS.sub(lambda m: str(unicodedata.decimal(m[0])) if m[0].isdecimal() else "." if m[0] == "\uFF0E" else "@", text)


def addresses(text: str) -> list[tuple[int, int]]:
    """Whole addresses of any length around the at signs of a folded text, also spelled out."""
    low, out, free = text.lower(), [], 0
    if not ("@" in low or ("dot" in low and "at" in low) or any(x in low for x in CLOSED_AT)):
        return out
    for m in AT.finditer(text):
        begin = m.start()
        while begin > free:
            if text[begin - 1].isalnum() or text[begin - 1] in LOCAL_CHARS:
                begin -= 1
            elif begin < m.start() and (d := DOT_BEFORE.search(text[max(free, begin - 10) : begin])):
                begin -= len(d[0])
            else:
                break
        if begin < m.start() and (rest := AFTER_AT.match(text, m.end())):
            out.append((begin, free := rest.end()))
    return out


def shown(text: str) -> str:
    """A folded text as the model reads it: spelled-out signs of addresses as the signs themselves; every place stays."""
    out, upto = [], 0
    for a, b in addresses(text):
        at = AT.search(text, a)
        rest = re.sub(SPELLED_DOT, lambda m: ".".center(len(m[0])), text[at.end() : b], flags=re.I)
        out += [text[upto : at.start()], "@".center(len(at[0])), rest]
        upto = b
    return "".join(out) + text[upto:] if out else text


def windows_of(text: str) -> list[int]:
    """Starts of the overlapping windows that cover the surroundings of every trigger of a folded text."""
    found = [m.span() for m in DIGITS.finditer(text)] if any(d in text for d in "0123456789") else []
    at = text.find("@")
    while at >= 0:
        found.append((at, at + 1))
        at = text.find("@", at + 1)
    found += addresses(text)
    starts, end = [], -1
    for first, last in sorted(found):
        lo, hi = max(0, first - REACH), last + REACH
        if lo < end - STRIDE + REACH and hi <= end:
            continue
        at = max(lo, end - STRIDE) if lo < end else lo
        while at + LENGTH < hi:
            starts.append(at)
            at += STRIDE
        starts.append(at)
        end = at + LENGTH
    return starts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis=axis)) + np.squeeze(m, axis)


class Tagger:
    """Both LSTM directions are kept in one array: direction 1 reads reversed windows."""

    def __init__(self, rng: np.random.Generator, embed: int = 16, hidden: int = 16):
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        self.h = hidden
        self.p = {
            "E": draw(N_CHARS, embed) * 3, "W": draw(2, embed, 4 * hidden), "U": draw(2, hidden, 4 * hidden),
            "b": np.zeros((2, 1, 4 * hidden), np.float32), "V": draw(2 * hidden, N_TAGS), "v": np.zeros(N_TAGS, np.float32),
            "A": np.zeros((N_TAGS, N_TAGS), np.float32),
        }
        self.p["b"][:, :, hidden : 2 * hidden] = 1  # remember at first
        self.allowed = np.zeros((N_TAGS, N_TAGS), np.float32)
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            self.allowed[:, inside] = IMPOSSIBLE
            self.allowed[[inside - 1, inside], inside] = 0

    def forward(self, chars: np.ndarray, keep: bool = False):
        """Tag scores (windows, places, tags), and what the backward pass needs."""
        p, h, (n, t) = self.p, self.h, chars.shape
        emb = p["E"][chars]
        x = np.stack([emb, emb[:, ::-1]])
        z = (x.reshape(2, n * t, -1) @ p["W"] + p["b"]).reshape(2, n, t, 4 * h)
        hid = np.zeros((2, n, t + 1, h), np.float32)
        cell = np.zeros((2, n, t + 1, h), np.float32)
        gates = np.empty((2, n, t, 4 * h), np.float32) if keep else None
        for s in range(t):
            a = z[:, :, s] + hid[:, :, s] @ p["U"]
            a[..., : 3 * h] = _sigmoid(a[..., : 3 * h])
            a[..., 3 * h :] = np.tanh(a[..., 3 * h :])
            cell[:, :, s + 1] = a[..., h : 2 * h] * cell[:, :, s] + a[..., :h] * a[..., 3 * h :]
            hid[:, :, s + 1] = a[..., 2 * h : 3 * h] * np.tanh(cell[:, :, s + 1])
            if keep:
                gates[:, :, s] = a
        both = np.concatenate([hid[0, :, 1:], hid[1, :, :0:-1]], axis=2)
        return both @ p["V"] + p["v"], (chars, x, hid, cell, gates, both)

    def backward(self, dlogits: np.ndarray, kept) -> dict[str, np.ndarray]:
        p, h = self.p, self.h
        chars, x, hid, cell, gates, both = kept
        n, t = chars.shape
        d = {"V": both.reshape(n * t, -1).T @ dlogits.reshape(n * t, -1), "v": dlogits.sum((0, 1))}
        db = dlogits @ p["V"].T
        dout = np.stack([db[..., :h], db[:, ::-1, h:]])
        dz = np.empty((2, n, t, 4 * h), np.float32)
        dh, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        ut = p["U"].transpose(0, 2, 1)
        for s in range(t - 1, -1, -1):
            i, f, o, g = (gates[:, :, s, k * h : (k + 1) * h] for k in range(4))
            tc = np.tanh(cell[:, :, s + 1])
            dh = dh + dout[:, :, s]
            dc = dc + dh * o * (1 - tc * tc)
            dz[:, :, s] = np.concatenate([dc * g * i * (1 - i), dc * cell[:, :, s] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=2)
            dc = dc * f
            dh = dz[:, :, s] @ ut
        flat = dz.reshape(2, n * t, 4 * h)
        d["W"] = x.reshape(2, n * t, -1).transpose(0, 2, 1) @ flat
        d["U"] = hid[:, :, :-1].reshape(2, n * t, h).transpose(0, 2, 1) @ flat
        d["b"] = flat.sum(1, keepdims=True)
        dx = (flat @ p["W"].transpose(0, 2, 1)).reshape(2, n, t, -1)
        dx = dx[0] + dx[1, :, ::-1]
        d["E"] = np.zeros_like(p["E"])
        np.add.at(d["E"], chars.ravel(), dx.reshape(n * t, -1))
        return d

    def crf(self, logits: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the negative log likelihood by scores and transitions."""
        n, t, k = logits.shape
        a = self.p["A"] + self.allowed
        fwd, bwd = np.empty_like(logits), np.zeros_like(logits)
        fwd[:, 0] = logits[:, 0]
        for s in range(1, t):
            fwd[:, s] = logits[:, s] + _lse(fwd[:, s - 1, :, None] + a, 1)
        for s in range(t - 2, -1, -1):
            bwd[:, s] = _lse(a + (logits[:, s + 1] + bwd[:, s + 1])[:, None], 2)
        total = _lse(fwd[:, -1], 1)[:, None, None]
        dlogits = np.exp(fwd + bwd - total)
        pair = np.exp(fwd[:, :-1, :, None] + a + (logits[:, 1:] + bwd[:, 1:])[:, :, None] - total[..., None]).sum((0, 1))
        np.subtract.at(dlogits, (np.arange(n)[:, None], np.arange(t), tags), 1)
        np.subtract.at(pair, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        return dlogits / n, pair / n

    def train(self, chars: np.ndarray, tags: np.ndarray, rng: np.random.Generator, steps: int, batch: int = 48, rate: float = 0.01) -> None:
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            at = rng.integers(0, len(chars), batch)
            logits, kept = self.forward(chars[at], keep=True)
            dlogits, da = self.crf(logits, tags[at])
            grads = self.backward(dlogits.astype(np.float32), kept) | {"A": da}
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                q[k] = 0.99 * q[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def decode(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (Viterbi) and their score margins over O, per place."""
        logits, _ = self.forward(chars)
        a = self.p["A"] + self.allowed
        n, t, k = logits.shape
        best = logits[:, 0] + np.array([IMPOSSIBLE if j and j % 2 == 0 else 0 for j in range(k)], np.float32)
        back = np.empty((n, t, k), np.int8)
        for s in range(1, t):
            every = best[:, :, None] + a
            back[:, s] = every.argmax(1)
            best = np.take_along_axis(every, back[:, s, None].astype(np.int64), 1)[:, 0] + logits[:, s]
        tags = np.empty((n, t), np.int8)
        tags[:, -1] = best.argmax(1)
        rows = np.arange(n)
        for s in range(t - 1, 0, -1):
            tags[:, s - 1] = back[rows, s, tags[:, s]]
        return tags, np.take_along_axis(logits, tags[..., None].astype(np.int64), 2)[..., 0] - logits[..., 0]


def labelled(text: str, start: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(LENGTH, np.int32)
    for kind, a, b in spans:
        if a < start + LENGTH and b > start:
            tags[max(0, a - start) : b - start] = 2 + 2 * kind
            if a >= start:
                tags[a - start] = 1 + 2 * kind
    return tags


def variant(rng: np.random.Generator) -> tuple[int, str]:
    """A made-up item: kind and text; kind -1 is no personal data."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    w = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvé"), rng.integers(3, 9)))
    pick = lambda *x: x[rng.integers(len(x))]
    kind = int(rng.integers(-1, 4))
    if kind == 0 and rng.random() < 0.5:
        local = pick(".", "-", "_", "").join(w() for _ in range(rng.integers(1, 6)))
        case = pick(str, str.upper)
        at = pick(" [at] ", " (at) ", "{at}", " {at} ", "<at>", "[at]", " at ", " at ", " at ")
        at, dot = case(at), case(" dot " if at == " at " else pick(" dot ", " [dot] ", " (dot) ", "{dot}", "[.]"))
        return 0, f"{local}{at}{dot.join(pick('', '-').join(w() for _ in range(rng.integers(1, 3))) for _ in range(rng.integers(1, 3)))}{dot}{case(pick('com', 'org', 'net', 'info'))}"
    if kind == 0:
        return 0, f"{w()}{pick('', '.', '_')}{w()}{pick('@', ' @ ', ' [at] ', ' (at) ', '(at)', '[at]')}{w()}{pick('.', ' . ', ' [dot] ', '.')}{pick('com', 'org', 'net', 'example.com')}"
    if kind == 1:
        x = rng.integers(0, 256, 4)
        return 1, pick(".", "[.]", " . ", "(.)").join(map(str, x))
    if kind == 2:
        x = d(15)
        x += next(c for c in "0123456789" if luhn(x + c))
        return 2, pick("", " ", ".", "_", "/").join(x[i : i + 4] for i in range(0, 16, 4))
    if kind == 3:
        a, b, c = d(3), d(3), d(4)
        return 3, pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+1 ({a}) {b}-{c}", f"001 {a} {b} {c}")
    return -1, pick(f"{d(1)}.{d(1)}", d(4), f"{d(2)}:{d(2)}", f"{d(4)}-{d(2)}-{d(2)}", f"v{d(1)}.{d(2)}.{d(1)}", f'token = "{rng.bytes(20).hex()}"', d(8), f"{d(1)}.{d(2)}", f"({d(4)})", f"{d(22)}")


def training_windows(texts: list[str], rng: np.random.Generator, made: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the given texts labelled by the base patterns, and made-up variants set into them."""
    chars, tags = [], []
    plain = [t for t in texts if t] or ["Lorem ipsum dolor sit amet, consectetur adipiscing elit sed do eiusmod tempor."]

    def add(text: str, start: int, spans: list) -> None:
        ids = char_ids(shown(text)[start : start + LENGTH])
        chars.append(np.pad(ids, (0, LENGTH - len(ids))))
        tags.append(labelled(text, start, spans))

    for text in texts:
        spans = base_spans(text)
        for start in windows_of(text := folded(text))[:20]:
            add(text, start, spans)
    for _ in range(made):
        host = plain[rng.integers(len(plain))]
        at = int(rng.integers(0, max(1, len(host) - LENGTH)))
        left = re.sub("[0-9@]", "", host[at : at + LENGTH])
        right = re.sub("[0-9@]", "", host[at + LENGTH : at + 2 * LENGTH])
        kind, item = variant(rng)
        text = f"{left} {item}{'' if rng.random() < 0.3 else ' '}{'.' if rng.random() < 0.2 else ''}{right}"
        a = len(left) + 1
        start = max(0, a - int(rng.integers(0, LENGTH - 20)))
        add(text, start, [(kind, a, a + len(item))] if kind >= 0 else [])
    return np.array(chars), np.array(tags)


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_docs: int = 2_000, made: int = 4_000, steps: int = 260, seed: int = 7) -> Tagger:
    """Train on windows of at most about ``max_docs`` texts and on ``made`` made-up ones."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    n = rows.select("id").count()
    some = sample_by_id(rows, n, max_docs).filter(F.col("text").rlike("[0-9@]")).select("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        # Only what surrounds the triggers, at most 20 windows of a text.
        for batch in batches:
            for t in batch.column("text").to_pylist():
                yield {"text": [t[max(0, s - REACH) : s + LENGTH + REACH] for s in windows_of(folded(t))[:20]]}

    texts = sorted(map_arrow(some, cut, "text string").toPandas()["text"].tolist())
    rng = np.random.default_rng(seed)
    chars, tags = training_windows(texts, rng, made)
    tagger = Tagger(rng)
    tagger.train(chars, tags, rng, steps)
    return tagger


def plausible(kind: int, text: str, a: int, b: int) -> bool:
    """The checks an added span of a folded text must pass."""
    s = text[a:b]
    if kind == 0:
        return True  # one of ``addresses``
    if any("0" <= c <= "9" for c in text[max(0, a - 1) : a] + text[b : b + 1]):
        return False
    digits = digits_of(s)
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]+(?:[ \[(]*\.[ \])]*[0-9]+){3}", s)) and is_ip(re.findall("[0-9]+", s))
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and len(re.findall("[0-9]+", s)) >= 3


def tag_texts(texts: list[str | None], tagger: Tagger, chunk: int = 512) -> list[tuple[list, list]]:
    """Base spans and all spans of every text, each by kind and start."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    read = [folded(t) for t in texts]
    seen = [shown(t) for t in read]
    starts = [windows_of(t) for t in read]
    where = [(k, s) for k, own in enumerate(starts) for s in own]
    # The places of a window that count: up to the middle of what it shares with the next one.
    edges = [e for own in starts for e in zip([0, *((a + LENGTH + b) // 2 if b < a + LENGTH else b for a, b in zip(own, own[1:], strict=False))], [*((a + LENGTH + b) // 2 if b < a + LENGTH else a + LENGTH for a, b in zip(own, own[1:], strict=False)), 1 << 60], strict=True)] if where else []
    parts: dict[int, list[list]] = {}  # runs of one kind per text: kind, start, end, margins
    for c in range(0, len(where), chunk):
        part = where[c : c + chunk]
        ids = np.zeros((len(part), LENGTH), np.int32)
        for row, (k, s) in enumerate(part):
            own = char_ids(seen[k][s : s + LENGTH])
            ids[row, : len(own)] = own
        tags, margin = tagger.decode(ids)
        for row in np.flatnonzero(tags.any(1)):
            (k, s), (lo, hi) = part[row], edges[c + row]
            a, size, runs = max(0, lo - s), min(LENGTH, len(read[k]) - s, hi - s), parts.setdefault(k, [])
            while a < size:
                tag = int(tags[row, a])
                b = a + 1
                while b < size and tag and tags[row, b] == tag + tag % 2:
                    b += 1
                if tag:
                    kind = (tag - 1) // 2
                    if tag % 2 == 0 and runs and runs[-1][0] == kind and runs[-1][2] == s + a:
                        runs[-1][2] = s + b  # goes on from the window before
                        runs[-1][3] += margin[row, a:b].tolist()
                    else:
                        runs.append([kind, s + a, s + b, margin[row, a:b].tolist()])
                a = b
    out = []
    for k, text in enumerate(read):
        taken = list(base[k])
        if text != texts[k]:  # what the patterns see in other scripts' signs
            taken += [x for x in base_spans(text) if all(x[2] <= a or x[1] >= b for _, a, b in base[k])]
        whole = addresses(text) if k in parts else []
        added = set()
        for kind, a, b, margins in parts.get(k, []):
            sure = -sum(margins) / len(margins)
            if kind == 0:
                added |= {(sure, 0, x, y) for x, y in whole if a < y and b > x}
                continue
            while a < b and not (text[a] in "(+" or "0" <= text[a] <= "9"):
                a += 1
            while b > a and not "0" <= text[b - 1] <= "9":
                b -= 1
            if a < b:
                added.add((sure, kind, a, b))
        for _, kind, a, b in sorted(added):
            if plausible(kind, text, a, b) and all(b <= x or a >= y for _, x, y in taken):
                taken.append((kind, a, b))
        out.append((base[k], sorted(taken)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, tagger: Tagger, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, base counts by kind, base_sha256 and spans."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            got = tag_texts(batch.column("text").to_pylist(), shared.value)
            out = {f"n_{name}": [sum(s[0] == k for s in base) for base, _ in got] for k, name in enumerate(KINDS)}
            out |= {"doc_id": batch.column("doc_id").to_pylist(), "spans": [joined(every) for _, every in got]}
            yield out | {"base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got]}

    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, schema)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans are replaced as one."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, tagger: Tagger, text: str = "text") -> DataFrame:
    """The rows themselves with personal data replaced in their text."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.names.index(text)
        texts = batch.column(at).to_pylist()
        got = tag_texts(texts, shared.value)
        new = [None if t is None else redact(t, every) for t, (_, every) in zip(texts, got, strict=True)]
        return batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return map_batches(docs, change)
