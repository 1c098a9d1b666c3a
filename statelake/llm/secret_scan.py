"""Secret scans: fixed patterns, and zstandard novelty of strings in sensitive places.

Beside the patterns, long strings that stand close behind a sensitive word are candidates. A candidate's novelty is what
it adds to a zstandard frame of its surroundings, when the compressor already knows common identifiers and the code around
the candidate: a name or a path adds a few bytes, a random value nearly its full entropy. Copies of a candidate are taken out of its
surroundings first. Candidates, of 16 characters or more, are measured in windows of at most 40, in which Huffman coding
does not pay, so that one bound serves all alphabets. Strings whose added bytes per character reach `NOVEL` are reported,
and so are their copies in sensitive places. A compressor does not know words it has not met: strings without digits, or mostly made
of words, must also be explained no better by the letter pairs around them than by chance. Lines that follow a candidate are candidates too,
in a PEM block all of them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from statelake.llm.common import named, whole_text

#: The patterns, their least lengths, and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: Runs of hex digits are maximal either way, so asking for the least length at once finds the same ones.
LONG_HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
KINDS = ("assign", "access", "hex", "novel")
KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)

#: Words that make a place sensitive, and how far behind them a candidate may begin.
SENSITIVE = re.compile(r"passw|passphrase|secret|token|api.?key|private.?key|access.?key|credential|authoriz|bearer|signature", re.I | re.A)
REACH, AROUND = 48, 256
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~-]{16,}")
#: Least added bytes per character; characters measured at a time; share of words in a string from which letter pairs decide
#: as well. Runs of 24 and more digits are hex spans already.
NOVEL, WINDOW, WORDED = 0.68, 40, 0.65
#: What may stand between the lines of one value, the rest of a PEM label, and its last line, which may be short.
BETWEEN = re.compile(r"""(?:\\[nr]|[\s"'`,;|>#*+\\]){1,16}""")
PEM, PEM_END = re.compile(r"[A-Z ]*-----"), "-----END"
SHORT_LINE = re.compile(r"(?:\\[nr]|[\s\"'`,;|>#*+])+([A-Za-z0-9+/=]{1,15})(?=(?:\\[nr]|[\s\"'`,;|>#*+])*-----END)")
#: Pieces that look like words, which the compressor knows in lower case.
WORDLIKE = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}")
WORDS = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}")
#: Bits of a letter by chance.
LETTER_BITS = math.log2(26)
#: Identifiers and code the compressor knows beforehand, besides the surroundings of a candidate.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 01234567890123456789012345678901 98765432109876543210 00000000 11111111 12345678 xxxxxxxxxxxxxxxxxxxxxxxx "
    "import from return class function const static public private protected void string integer boolean float double "
    "self this null none true false default example sample placeholder changeme your_api_key_here insert_token_here "
    "username user_name password passwd passphrase secret secret_key client_secret client_id token access_token "
    "refresh_token id_token session_token api_key apikey access_key private_key public_key credentials authorization "
    "bearer basic signature config configuration settings environment variable os.environ getenv process.env "
    "http://www. https://www. .com .org .net .example.com localhost 127.0.0.1 /usr/local/bin /home/user/ /etc/ /var/log/ "
    "get_value set_value load_config read_file write_file connect_database connection_string database_url "
    "max_length min_length timeout_seconds retry_count total_number_of first_name last_name created_at updated_at "
    "the and that with from this have which there their would about could should because between through "
)


class Novelty:
    """Bytes that a candidate adds to the compressed text around it."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        # level 19 parses exhaustively, so that sizes of short frames tell literals from matches
        self.base = identifiers.encode()
        self.pairs = self._pairs(identifiers)

    @staticmethod
    def _pairs(text: str) -> Counter[str]:
        return Counter(w[k:k + 2] for w in re.findall(r"[a-z]{2,}", text.lower()) for k in range(len(w) - 1))

    def letter_bits(self, before: str, candidate: str, after: str) -> float:
        """Bits of a letter of the candidate by the letter pairs of identifiers and surroundings."""
        pairs = self.pairs + self._pairs(before + " " + after)
        firsts: Counter[str] = Counter()
        for p, n in pairs.items():
            firsts[p[0]] += n
        mine = self._pairs(candidate)
        bits = sum(-n * math.log2((pairs[p] + 0.25) / (firsts[p[0]] + 6.5)) for p, n in mine.items())
        return bits / mine.total() if mine else LETTER_BITS

    def novel(self, before: str, candidate: str, after: str) -> bool:
        """Whether the surroundings do not explain the candidate, by windows over its whole length.

        Where words make up most of it, letter pairs must not explain it either.
        """
        added = self._adder(before, after)
        count = -(-len(candidate) // WINDOW)
        cuts = [len(candidate) * k // count for k in range(count + 1)]
        total = sum(added(candidate[a:b]) for a, b in zip(cuts, cuts[1:]))
        if total < NOVEL * len(candidate):
            return False
        worded = sum(len(w) for w in WORDS.findall(candidate)) >= WORDED * len(candidate)
        if any(c.isdigit() for c in candidate) and not worded:
            return True
        return self.letter_bits(before, candidate, after) >= LETTER_BITS

    def _adder(self, before: str, after: str) -> Callable[[str], int]:
        """A measure of pieces of one candidate: the dictionary and the compressor are made once."""
        known = zstandard.ZstdCompressionDict(
            self.base + before.encode("utf-8", "replace") + after.encode("utf-8", "replace"),
            dict_type=zstandard.DICT_TYPE_RAWCONTENT,
        )
        packer = zstandard.ZstdCompressor(level=19, dict_data=known, write_content_size=False, write_checksum=False)
        tail = before[-32:].encode("utf-8", "replace")
        alone = len(packer.compress(tail))

        def added(piece: str) -> int:
            # words joined in CamelCase are known by their lower-case forms
            plain = WORDLIKE.sub(lambda w: w.group().lower(), piece)
            return min(len(packer.compress(tail + c.encode())) for c in {piece, plain}) - alone

        return added

    def added(self, before: str, candidate: str, after: str) -> int:
        return self._adder(before, after)(candidate)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and without overlap within a kind."""
    out = []
    if KEYWORD.search(text):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), "hex", m.end()) for m in LONG_HEX.finditer(text)]
    return out


def novel_spans(text: str, novelty: Novelty, taken: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Strings behind a sensitive word that the surroundings do not explain and that no span of `taken` meets.

    Every copy counts as novel where one is, by the text around it without any copy.
    """
    found: list[tuple[int, int, str]] = []
    novel: set[str] = set()
    done = 0
    spans = sorted((s, e) for s, _, e in taken)
    at = 0
    for word in SENSITIVE.finditer(text):
        reach = word.end() + REACH
        if PEM.match(text, word.end()) and (ends := text.find(PEM_END, word.end())) >= 0:
            reach = max(reach, ends)
        for m in CANDIDATE.finditer(text, max(done, word.end())):
            # lines that follow the last candidate are near as well
            if m.start() > reach and not (done > word.end() and BETWEEN.fullmatch(text, done, m.start())):
                break
            done = m.end()
            value = m.group()
            while at < len(spans) and spans[at][1] <= m.start():
                at += 1
            if any(s < m.end() for s, _ in spans[at:at + 1]):
                continue
            core = _core(value)
            found.append((m.start(), m.end(), core))
            if core not in novel and novelty.novel(*_around(text, m, core)):
                novel.add(core)
            short = SHORT_LINE.match(text, done)
            if short and core in novel:
                done = short.end()
                found.append((short.start(1), short.end(1), core))
    return [(start, "novel", end) for start, end, core in found if core in novel]


def _core(value: str) -> str:
    """What copies of a value have in common: `=X` behind a word and `X` are the same."""
    return value.strip("=_~-") or value


def _around(text: str, m: re.Match, core: str) -> tuple[str, str, str]:
    """Text before the candidate, the candidate, and text behind it, without copies of `core`, those at the rims too."""
    copy = re.compile(re.escape(core), re.I | re.A)
    wide = AROUND + len(core)
    before = copy.sub(" ", text[max(0, m.start() - wide):m.start()])
    return before[-AROUND:], m.group(), copy.sub(" ", text[m.end():m.end() + wide])[:AROUND]


def every_span(text: str, novelty: Novelty) -> list[tuple[int, str, int]]:
    """All spans by start, then kind in the order of `KINDS`; code points, end exclusive."""
    base = base_spans(text)
    return sorted(base + novel_spans(text, novelty, base), key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def spans_of(text: str, novelty: Novelty) -> list[tuple[int, str, int]]:
    """`every_span` with each novel value once, where it stands first."""
    seen: set[str] = set()
    out = []
    for start, kind, end in every_span(text, novelty):
        core = _core(text[start:end])
        if kind != "novel" or core not in seen:
            out.append((start, kind, end))
        if kind == "novel":
            seen.add(core)
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, counts of the fixed kinds, `n_novel`, `base_sha256`, `spans`; one row per row, each whole text.

    A null text is empty and has no spans. Text is read once, in the task that holds it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            digests, told = [], []
            for text in batch.column(1).to_pylist():
                spans = every_span(text, novelty)
                for kind in KINDS:
                    counts[kind].append(sum(s[1] == kind for s in spans))
                base = joined([s for s in spans if s[1] != "novel"])
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                told.append(joined(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()),
                 pa.array(told, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    return docs.select(named(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, schema)
