"""Secret scanning: candidate strings judged by a random forest trained from labelled findings."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import bounded_batches, byte_table, Chunk, chunks, runs

#: A candidate is a run of these bytes, SHORTEST or more, with a digit, or with LONGEST_PLAIN or more; or an assigned value.
_PART = byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-.~")
_DIGIT = byte_table(b"0123456789")
SHORTEST = 16
LONGEST_PLAIN = 32
#: Bytes before and after a candidate that its neighbouring words are taken from.
CONTEXT = 48
THRESHOLD = 0.5
TREES = 30
DEPTH = 9
SEED = 13

#: Words that stand near secrets, and near strings that only look like secrets. Fixed values.
SECRET_WORDS = "token secret key apikey password passwd pwd auth bearer credential credentials private access api signing".split()
HARMLESS_WORDS = "commit sha sha1 sha256 md5 hash checksum digest uuid guid revision build version etag integrity isbn phone card call invoice order id".split()
#: Paths where strings are rarely real.
HARMLESS_PATHS = "test tests example examples sample samples doc docs fixture fixtures mock lock".split()
#: Values that stand where a secret would and are none. Fixed values.
PLAIN_VALUES = frozenset("null none nil true false required optional string text value undefined unknown empty example changeme redacted hidden default".split())
#: A small dictionary for coverage.
DICTIONARY = frozenset(
    "the and for that with this from have not are was you all can her has one our out day get use man new now way may say "
    "each which their time will about many then them these some would make like into look more write number people first "
    "water been called oil its who down side over word but what said there when your how tion ing ment able ness less ship "
    "user name file path data test example value default config server client host port local public index page image style "
    "color width height button click event model view list item table row column string number object array map set node tree "
    "placeholder changeme sample dummy foo bar baz lorem ipsum readme license copyright version release build commit author".split()
)

_WORDS = re.compile(r"[a-z0-9]+")
_SIGN = rb"""["']?[ \t]*(?::=|=>|[=:])[ \t]*"""
#: In lower case: a secret word and the sign that assigns a value to it; the value, quoted or up to white space.
_ASSIGNS = re.compile(b"(?:%s)%s" % ("|".join(SECRET_WORDS).encode(), _SIGN))
_VALUE = re.compile(rb"""\"([^"\r\n]+)"|'([^'\r\n]+)'|((?:(?!&\w+=)[^\s"'`])+)""")
_AFTER_SIGN = re.compile(_ASSIGNS.pattern + rb"""["']?$""")


def features(candidate: str, before: str, after: str, path: str) -> list[float]:
    """Length, character transitions, dictionary coverage, path and neighbouring words of a candidate."""
    n = len(candidate)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "p" for c in candidate]
    changes = Counter(zip(kinds, kinds[1:]))
    total = max(1, n - 1)
    counts = Counter(candidate)
    entropy = -sum(k / n * np.log2(k / n) for k in counts.values())
    lower = candidate.lower()
    covered = np.zeros(n, dtype=bool)
    for size in (3, 4, 5, 6, 7):
        for i in range(n - size + 1):
            if lower[i : i + size] in DICTIONARY:
                covered[i : i + size] = True
    near = _WORDS.findall(before.lower())[-4:]
    far = _WORDS.findall(after.lower())[:2]
    parts = _WORDS.findall(path.lower())
    tail = before.rstrip("\"' ")[-1:]
    pieces = [p for p in re.split(r"[-./_=+~]", candidate) if p]
    return [
        n,
        entropy,
        len(counts) / n,
        kinds.count("d") / n,
        kinds.count("u") / n,
        kinds.count("l") / n,
        kinds.count("p") / n,
        (changes["l", "d"] + changes["d", "l"]) / total,
        (changes["l", "u"] + changes["u", "l"]) / total,
        (changes["u", "d"] + changes["d", "u"]) / total,
        sum(v for (a, b), v in changes.items() if a != b) / total,
        covered.mean(),
        max(map(len, pieces), default=0) / n,
        float(all(c in "0123456789abcdef-" for c in lower)),
        float(tail in "=:" if tail else 0),
        float(before[-1:] in "\"'" if before else 0),
        sum(w in SECRET_WORDS for w in near),
        sum(w in HARMLESS_WORDS for w in near) + sum(w in HARMLESS_WORDS for w in far),
        sum(w in HARMLESS_PATHS for w in parts),
        float("." in candidate and bool(re.search(r"[a-z]\.(com|org|net|html|io)", lower))),
        float(bool(_AFTER_SIGN.search(before.lower().encode()))),
        sum(c in "${}<>()[]" for c in candidate) / n,
        candidate.count(" ") / n,
        float(lower in PLAIN_VALUES),
    ]


def labelled_findings(n: int = 1600, seed: int = SEED) -> list[tuple[int, str, str, str, str]]:
    """Labelled findings (1 for a secret, candidate, before, after, path), made by rule from a seed.

    Half are keys as services issue them and passwords as people choose them, in assignments; half are
    what scanners wrongly report: card numbers, hashes named as such, uuids, long words, paths, hosts,
    placeholders, identifiers, and what else is assigned to a secret's name: plain values, references, words.
    """
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    draw = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), int(k)))
    hexes, digits, lower = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz"
    mixed = lower + lower.upper() + digits
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ung heit keit lich ment tion elle eau que cion ado mente".split()
    prose = lambda k: " ".join("".join(pick(syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(k))
    word = lambda k: "".join(pick(syllables) for _ in range(k))
    names = ["token", "api_key", "secret", "password", "auth_token", "access_key", "client_secret", "private_key", "API_TOKEN"]
    out = []
    for k in range(n):
        path = pick(["src/app.py", "config/prod.yml", f"src{k % 20}", "deploy.env", "notes.txt", ""])
        if k % 2 == 0:
            value = pick([draw(hexes, pick([32, 40, 64])), draw(mixed, rng.integers(20, 64)), "AKIA" + draw(lower.upper() + digits, 16),
                          "ghp_" + draw(mixed, 36), "sk-" + draw(mixed, 40), draw(mixed + "+/", 43) + "=",
                          draw(mixed + "!@#%&*?-_", rng.integers(8, 20)), draw(pick([lower, lower + lower.upper()]), rng.integers(16, 32)),
                          pick([str.lower, str.capitalize])(word(int(rng.integers(2, 5)))) + draw(digits, rng.integers(1, 5)) + pick(["", "!", "?", "#", "&"]) + draw(digits, 1),
                          pick(["-", "_", " "]).join([word(2) for _ in range(3)] + [draw(digits, 2)])])
            sign, quote = pick([" = ", "=", ": "]), pick(['"', "'", '"', ""])
            lead = pick(["", "export ", "const "]) + pick(names)
            out.append((1, value, f"{prose(4)} {lead}{sign}{quote}", f"{quote}{pick(['', '###', '!!', ';'])} {prose(3)}", path))
            continue
        shape = k // 2 % 12
        before, after = prose(5) + " ", " " + prose(3)
        if shape > 8:
            sign, quote = pick([" = ", "=", ": ", ": "]), pick(['"', "'", "", ""])
            before, after = f"{prose(4)} {pick(names)}{sign}{quote}", f"{quote}{pick(['', ',', ';'])} {prose(3)}"
        if shape == 0:
            value = draw(digits, pick([16, 16, 19]))
        elif shape == 1:
            value, before = draw(hexes, pick([32, 40, 64])), f"{prose(3)} {pick(HARMLESS_WORDS[:12])}{pick([' ', ': ', '='])}"
        elif shape == 2:
            h = draw(hexes, 32)
            value = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"
        elif shape == 3:
            value = word(int(rng.integers(7, 16))) + pick(["", "1", "2", ".3"])
        elif shape == 4:
            value, before = f"{word(3)}.example.com/{word(2)}/{draw(digits, 4)}", prose(3) + pick([" https://", " mail ", " www."])
        elif shape == 5:
            value, before = pick(["xxxxxxxxxxxxxxxxxxxx1", "your-token-here-123", "changeme-changeme-1", "0000000000000000000000"]), f"{pick(names)} = \""
        elif shape == 6:
            value = "-".join(word(2) for _ in range(4)) + draw(digits, 2)
        elif shape == 7:
            value = f"{draw(digits, 4)}-{draw(digits, 2)}-{draw(digits, 2)}-{word(3)}"
        elif shape == 9:
            value = pick([*sorted(PLAIN_VALUES), draw(digits, rng.integers(1, 4)), "v" + draw(digits, 1), ".".join(draw(digits, 3)), pick("*x") * int(rng.integers(3, 12))])
        elif shape == 10:
            name = pick(names).upper()
            value = pick(["${%s}" % name, "$%s" % name, "{{ %s }}" % name.lower(), "<your-%s>" % name.lower(), "get_%s()" % name.lower(),
                          "self.%s" % name.lower(), "os.environ[%s]" % name, "process.env.%s" % name, "config.%s" % word(2)])
        elif shape == 11:
            value = word(int(rng.integers(1, 4)))
            if '"' not in before and "'" not in before:
                value = pick([value, value.capitalize()])
            else:
                value = prose(int(rng.integers(4, 9)))
        else:
            value, path = draw(hexes, 40), pick(["tests/fixtures/a.txt", "docs/example.md", "package.lock"])
        out.append((0, value, before, after, path))
    return out


class Forest:
    """Decision trees over bootstrap samples, each split by the best of a few random features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        self.rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            own = self.rng.integers(0, len(y), len(y))
            nodes: list[tuple] = []
            self._grow(x[own], y[own].astype(float), depth, nodes)
            self.trees.append([np.array(c) for c in zip(*nodes, strict=True)])

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, nodes: list[tuple]) -> int:
        """Append (feature, bound, left, right, share of 1); a leaf has feature -1."""
        at = len(nodes)
        nodes.append((-1, 0.0, at, at, y.mean()))
        best = (1e-9, -1, 0.0)
        if depth and len(y) >= 4 and 0 < y.mean() < 1:
            impurity = y.mean() * (1 - y.mean())
            for f in self.rng.choice(x.shape[1], max(2, int(np.sqrt(x.shape[1])) + 1), replace=False):
                order = np.argsort(x[:, f], kind="stable")
                v, left = x[order, f], np.cumsum(y[order])
                cut = np.flatnonzero(v[1:] > v[:-1])
                if not len(cut):
                    continue
                n = cut + 1
                p, q = left[cut] / n, (left[-1] - left[cut]) / (len(y) - n)
                gain = impurity - (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], int(f), (v[cut[k]] + v[cut[k] + 1]) / 2)
        if best[1] >= 0:
            inside = x[:, best[1]] <= best[2]
            left = self._grow(x[inside], y[inside], depth - 1, nodes)
            right = self._grow(x[~inside], y[~inside], depth - 1, nodes)
            nodes[at] = (best[1], best[2], left, right, y.mean())
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, bound, left, right, share in self.trees:
            at = np.zeros(len(x), dtype=int)
            while (inner := feature[at] >= 0).any():
                f = np.where(inner, feature[at], 0)
                at = np.where(inner, np.where(x[np.arange(len(x)), f] <= bound[at], left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


@functools.lru_cache(maxsize=4)
def trained_forest(seed: int = SEED) -> Forest:
    """The forest of the labelled findings; the same wherever it is trained."""
    found = labelled_findings(seed=seed)
    x = np.array([features(c, b, a, p) for _, c, b, a, p in found])
    return Forest(x, np.array([f[0] for f in found]), seed=seed)


def candidates(chunk: Chunk) -> list[tuple[int, int, int]]:
    """(row, first byte, end) of the candidate strings of a chunk's whole texts, within the row."""
    starts, ends, first = runs(_PART[chunk.data], chunk.offsets)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[chunk.data])])
    size = ends - starts
    keep = ((size >= SHORTEST) & (digits[ends] > digits[starts])) | (size >= LONGEST_PLAIN)
    at = np.flatnonzero(keep)
    rows = np.searchsorted(first, at, side="right") - 1
    base = chunk.offsets[rows]
    return list(zip(rows.tolist(), (starts[at] - base).tolist(), (ends[at] - base).tolist(), strict=True))


def _trimmed(text: bytes, a: int, b: int) -> tuple[int, int]:
    """A candidate without the sentence marks at its ends, and after the last ``name=``."""
    piece = text[a:b]
    cut = piece.rstrip(b"=").rfind(b"=") + 1
    a += cut
    piece = text[a:b]
    a += len(piece) - len(piece.lstrip(b".-~_/"))
    return a, a + len(text[a:b].rstrip(b".-~_/"))


def assigned(text: bytes) -> list[tuple[int, int]]:
    """(first byte, end) of the values that a whole text assigns to secret words, of any length; they don't overlap."""
    out, last = [], 0
    for head in _ASSIGNS.finditer(text.lower()):
        value = _VALUE.match(text, head.end()) if head.start() >= last else None
        if value:
            a, b = value.span(value.lastindex)
            last = b
            b = a + len(text[a:b].rstrip(b" \t,;.)]}>" if value.lastindex == 3 else b" \t"))
            if b > a:
                out.append((a, b))
    return out


def _spans(chunk: Chunk) -> Iterator[tuple[int, bytes, list[tuple[int, int]]]]:
    """Each row of a chunk that has candidates: (row, its text, their distinct spans of bytes in order)."""
    found: list[set] = [set() for _ in range(len(chunk))]
    for row, a, b in candidates(chunk):
        found[row].add((a, b))
    for row, spans in enumerate(found):
        text = chunk.row(row)
        spans = {(a, b) for a, b in (_trimmed(text, *s) for s in spans) if b - a >= SHORTEST}
        if spans := spans | set(assigned(text)):
            yield row, text, sorted(spans)


def _judged(batch: pa.RecordBatch, threshold: float) -> list[list[tuple[int, int, float, bool]]]:
    """Per row of (id, text, path): (start, end, score, is a secret) in characters."""
    out: list[list] = [[] for _ in range(batch.num_rows)]
    rows, x, spans = [], [], []
    for chunk in chunks(batch.column(1)):
        # bytes that begin a character, all but 10xxxxxx, counted up to each byte
        heads = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
        for row, text, found in _spans(chunk):
            path = batch.column(2)[chunk.first + row].as_py() or ""
            at = int(chunk.offsets[row])
            for a, b in found:
                before = text[max(0, a - CONTEXT) : a].decode(errors="ignore")
                after = text[b : b + CONTEXT].decode(errors="ignore")
                rows.append(chunk.first + row)
                x.append(features(text[a:b].decode(), before, after, path))
                spans.append((int(heads[at + a] - heads[at]), int(heads[at + b] - heads[at])))
    if rows:
        scores = trained_forest().predict(np.array(x))
        for row, (a, b), score in zip(rows, spans, scores.tolist(), strict=True):
            out[row].append((a, b, score, score >= threshold))
    return out


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD
) -> DataFrame:
    """``(doc_id, findings)``, one row per row of ``docs``; findings holds every candidate.

    A candidate is a run of letters, digits and ``+/=_-.~`` of 16 characters or more with a digit,
    or of 32 or more, or, at any length, what a secret word (``password = "..."``) is given: the quoted
    text, or all up to white space. Two candidates may overlap. A candidate's struct has start and end (characters of the whole text), score (the share
    of the forest's votes) and secret (score at or above ``threshold``), in the order of start.
    The forest judges length, character transitions, dictionary coverage, the path (``path_col``,
    may be None) and neighbouring words; each worker trains it once from labelled findings that a
    rule makes. Null and empty texts have no findings; a null path has no words. Ids may be null or
    repeated; other columns are ignored; an empty table gives an empty result. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    path = F.col(path_col).cast("string") if path_col else F.lit("")
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("secret", pa.bool_())])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(item.names, f, strict=True)) for f in row] for row in _judged(batch, threshold)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], ["doc_id", "findings"])

    schema = f"doc_id {kind}, findings array<struct<start: bigint, end: bigint, score: double, secret: boolean>>"
    return bounded_batches(docs.select(F.col(id_col), F.col(text_col), path.alias("path"))).mapInArrow(one, schema)


def redact_secrets(
    docs: DataFrame, text_col: str = "text", path_col: str | None = "source", mark: str = "[SECRET]", threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with each secret in the text replaced by ``mark``; all rows and columns stay.

    Secrets that overlap get one mark. Null texts stay null; see ``find_secrets`` for what counts as a secret.
    """
    names = docs.columns
    at = names.index(text_col)
    path = F.col(path_col).cast("string") if path_col else F.lit("")
    rows = docs.select(*[F.col(f"`{n}`") for n in names], path.alias("__path"))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view = pa.RecordBatch.from_arrays([batch.column(0), batch.column(at), batch.column(len(names))], ["i", "t", "p"])
            texts = batch.column(at).to_pylist()
            for i, found in enumerate(_judged(view, threshold)):
                pieces, at_char = [], 0
                for start, end, _, secret in found:
                    if secret and start >= at_char:
                        pieces += [texts[i][at_char:start], mark]
                    if secret:
                        at_char = max(at_char, end)
                if pieces:
                    texts[i] = "".join([*pieces, texts[i][at_char:]])
            columns = [pa.array(texts, batch.column(at).type) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return bounded_batches(rows).mapInArrow(one, docs.schema)
