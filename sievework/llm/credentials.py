"""Problem 5: credentials embedded in source code and configuration.

Configuration is parsed into key paths with offsets (JSON, YAML, TOML, XML, INI and environment formats), scripts into
string literals with the names that govern them. A value counts if its own shape proves it, or if its key is sensitive and its
shape fits. Redactions are spliced into the original bytes, everything else stays as it is.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.config_paths import pairs_of
from sievework.llm.files import per_file
from sievework.llm.functions import NAME, PUNCT, STRING, TEMPLATE, Scanner
from sievework.llm.script_parser import DIALECTS
from sievework.shared import table


@dataclass(frozen=True)
class Credential:
    """Offsets of the secret part in the text, and its kind."""

    start: int
    end: int
    kind: str


# ---- names

_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zß-ÿ]+|\d+")
# Words that make a key sensitive, in four languages.
_SENSITIVE = frozenset(
    "password passwords passwd passwort passphrase passphrases pass pwd pw psw secret secrets token tokens apikey auth authtoken authorization authorisation credential credentials cred creds bearer jwt hmac "
    "kennwort geheimnis geheim zugangsschluessel zugangsschlüssel zugangsdaten contrasena contraseña clave secreto credencial motdepasse mdp jeton secrete cookie".split()
)
# A key of one of these kinds is sensitive: the word before "key" (or its translations) says so.
_KEY_KINDS = frozenset("api access private secret signing sign shared encryption encrypt master auth account storage service ssh deploy license hmac client server webhook session app application zugang".split())
_KEY_WORDS = frozenset("key keys schluessel schlüssel cle clé llave clave".split())
# Words that turn the name into one of something that is no secret.
_HARMLESS = frozenset(
    "public name names ttl length len min max count limit label labels hint placeholder message messages text title path file url uri endpoint field type kind expiry expires expiration age policy regex pattern digest checksum hash sha integrity commit trace revision header index id ids size width column form input page screen dialog prompt rotation rotate enabled required description".split()
)


def words_of(name: str) -> list[str]:
    return [w.lower() for w in _PART.findall(name)]


def sensitivity(name: str) -> int:
    """2 for a sensitive name, 1 for a bare "key" and the like, 0 for others."""
    words = words_of(name)
    if not words:
        return 0
    joined = "".join(w for w in words if not w.isdigit())
    pairs = {a + b for a, b in zip(words, words[1:])} | {a + b + c for a, b, c in zip(words, words[1:], words[2:])}
    hit = bool(_SENSITIVE & ({*words, joined} | pairs))
    keyed = any(w in _KEY_WORDS for w in words)
    hit = hit or keyed and any(w in _KEY_KINDS for w in words) or "signing" in words or "signer" in words
    if "public" in words:
        return 0
    if hit:
        plain = [w for w in words if not w.isdigit()]
        if plain[-1] in _HARMLESS or len(plain) > 1 and plain[-1] in ("length", "ttl"):
            return 0
        return 2
    return 1 if keyed or words[0] in ("target", "hook", "session", "pem", "cert") else 0


# ---- shapes

_PLACEHOLDER = re.compile(
    r"^(?:[x*.\-_#?0]+|change[\-_ ]?(?:me|it|this)\W*|replace[\-_ ]?(?:me|this|with)?.*|(?:your|my|the|insert|enter|put|add|set|some|a|an|dein|ihr|tu|su|votre)[\-_ .].*|<.*>|\$\{.*\}|\$\(.*\)|\$[A-Za-z_]\w*|\{\{.*\}\}|\{%.*%\}|\{\w*\}|%\w+%|%\{.*\}|@\w+@|__\w+__|\[.*\]|\(.*\)|"
    r"(?:env|vault|secret|secrets|ssm|file|kms|ref\+\w+|op|sops|aws-sm|gcp-sm|keyring|parameter)[:.].*|arn:.*|!\w+.*|process\.env.*|redacted|masked|hidden|removed|none|null|nil|undefined|true|false|yes|no|on|off|~|example.*|sample.*|dummy.*|fake.*|test|todo|tbd|fixme|n/?a|placeholder.*|default|secret|password|passwd|passwort|pass|token|key|apikey|api[_\-]key|admin|root|user|username|string|value|empty|unset|foo|bar|baz|foobar|abc|abc123|123\d*|password123|test123|s3cr3t|hunter2|qwerty\w*|lorem.*)$",
    re.I,
)
_ALGORITHM = re.compile(r"^(?:sha-?\d+\w*|md5|hs\d+|rs\d+|es\d+|utf-?\d+\w*|base\d+\w*|aes-?\d+.*|oauth-?\d*|ed25519|rsa-?\d*|bcrypt|argon2\w*|v?\d+(?:\.\d+)*|tls-?v?[\d.]+|iso-?\d.*|x509|pkcs\d*|p256|ecdsa.*)$", re.I)
_NOT_SECRET = re.compile(r"^(?:sha\d+[-:]|md5[-:]|data:|https?://|wss?://|/|\.{1,2}/|~/|[A-Za-z]:\\|mailto:|tel:|#[0-9a-fA-F]{3,8}$|\d{4}-\d\d-\d\d|-----BEGIN (?:[A-Z]+ )*(?:PUBLIC KEY|CERTIFICATE))")
_HOST = re.compile(r"^(?:[a-z0-9\-]+\.)+(?:example|test|invalid|local|localhost|internal|com|org|net|io|dev)(?::\d+)?$", re.I)
_CLASSES = (re.compile(r"[a-z]"), re.compile(r"[A-Z]"), re.compile(r"\d"), re.compile(r"[^A-Za-z\d]"))


def is_placeholder(v: str) -> bool:
    return not v or bool(_PLACEHOLDER.match(v))


def looks_secret(v: str, strict: bool = False) -> bool:
    """Whether a value has the shape of a password, key or token. ``strict`` is for values whose key proves little."""
    v = v.strip()
    if len(v) < 6 or re.search(r"\s", v) or is_placeholder(v) or _ALGORITHM.match(v) or _NOT_SECRET.match(v) or _HOST.match(v):
        return False
    if "${" in v or "{{" in v:
        return False
    low, up, digit, other = (bool(c.search(v)) for c in _CLASSES)
    if strict:
        return len(v) >= 20 and digit and (low or up) and not re.search(r"[^\w+/=.\-]", v)
    if v.isdigit():
        return len(v) >= 10
    if digit and (low or up):
        return len(v) >= 8 or other
    return low and up and other and len(v) >= 8 and not re.match(r"^[A-Za-z]+(?:[\-_ .:/][A-Za-z]+)*[.!?:]?$", v) or len(v) >= 24 and low and up and not other and not re.match(r"^(?:[A-Z]?[a-z]+)+$", v)


_STRONG = re.compile(
    r"(?P<pem>-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)"
    r"|(?P<aws>(?<![A-Za-z0-9])(?:AKIA|ASIA|AGPA|AIDA|AROA)[0-9A-Z]{16}(?![0-9A-Za-z]))"
    r"|(?P<jwt>(?<![\w\-])eyJ[\w\-]{8,}\.[\w\-]{8,}\.[\w\-]{8,})"
    r"|(?P<vendor>(?<![\w\-])(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{22,}|glpat-[\w\-]{20,}|xox[abeoprs]-[\w\-]{10,}|[srp]k_(?:live|test|prod)_[A-Za-z0-9]{8,}|whsec_[A-Za-z0-9+/=]{16,}|AIza[\w\-]{35}|ya29\.[\w\-]{20,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|sk-(?:[a-z]+-)*[A-Za-z0-9_\-]{20,}|dop_v1_[0-9a-f]{40,}|shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}|pypi-[\w\-]{50,}|key-[0-9a-f]{32}|[a-z]{2,6}_(?:live|prod|test|dev|stage|staging|prd|sandbox)_[A-Za-z0-9]{16,}))"
    r"|(?P<url>[A-Za-z][A-Za-z0-9+.\-]*://(?P<user>[^\s:/@'\"`<>]*):(?P<word>[^\s/@'\"`<>]+(?:@[^\s/@'\"`<>.]*(?=@))?)@[\w${\[<])"
    r"|(?P<hook>https?://[^\s/'\"`<>]*hook[^\s/'\"`<>]*/(?P<path>[^\s'\"`<>]*[A-Za-z0-9_\-]{16,}))"
    r"|(?P<hook2>https?://[^\s'\"`<>]*/(?:services/T[A-Z0-9]{6,}/B[A-Z0-9]{6,}|(?:api/)?webhooks?/[\w\-]+)/(?P<path2>[A-Za-z0-9_\-]{12,}))"
    r"|(?P<scheme>\b(?:Bearer|Basic|Token|ApiKey|Digest)\s+(?P<value>[A-Za-z0-9+/=_.\-~!#%^&*$@]{8,}))"
)
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
# Words by which most lines can be told to hold nothing of a strong shape, tested before the expression above.
_STRONG_HINT = re.compile(r"PRIVATE KEY|AKIA|ASIA|AGPA|AIDA|AROA|eyJ|gh[pousr]_|github_pat_|glpat-|xox|[a-z]{2}_(?:live|test|prod|dev|stag|prd|sand)|whsec_|AIza|ya29|SG\.|npm_|hf_|sk-|dop_v1|shp|pypi-|key-|://|Bearer|Basic|Token|ApiKey|Digest")


def _random(segment: str) -> bool:
    return len(segment) >= 12 and bool(re.search(r"\d", segment)) and bool(re.search(r"[A-Za-z]", segment))


def strong(text: str, low: int = 0, high: int | None = None) -> Iterator[Credential]:
    """Values whose shape alone proves a credential."""
    high = len(text) if high is None else high
    if not _STRONG_HINT.search(text, low, high):
        return
    at = low
    while True:
        m = _STRONG.search(text, at, high)
        if not m:
            return
        at = m.end()
        if m.group("pem"):
            stop = _PEM_END.search(text, m.end(), high)
            end = stop.end() if stop else min([p for p in (text.find(c, m.end(), high) for c in "\"'`") if p >= 0] or [high])
            # a header that is only named, as in a message or a pattern, holds no key
            if re.search(r"[A-Za-z0-9+/=]{16,}", text[m.end() : end]):
                yield Credential(m.start(), end, "private_key")
                at = end
        elif m.group("aws"):
            if not m.group("aws").endswith("EXAMPLE"):
                yield Credential(m.start(), m.end(), "access_key_id")
        elif m.group("jwt"):
            yield Credential(m.start(), m.end(), "token")
        elif m.group("vendor"):
            tail = m.group("vendor")
            if not re.search(r"x{6,}|\*{4,}|0{8,}|1234567|example|your", tail, re.I):
                yield Credential(m.start(), m.end(), "token")
        elif m.group("url"):
            word = m.group("word")
            if "${" not in m.group("url") and not is_placeholder(word) and not re.match(r"^(?:pass\w*|pwd|pw|secret|\w*password|\{.*|\$.*|\*+|:.*)$", word, re.I) and len(word) >= 4:
                yield Credential(m.start("word"), m.end("word"), "url_password")
        elif m.group("hook"):
            if _random(re.split(r"[/?#]", m.group("path"))[-1]):
                yield Credential(m.start("path"), m.end("path"), "secret_path")
        elif m.group("hook2"):
            if _random(m.group("path2")):
                yield Credential(m.start("path2"), m.end("path2"), "secret_path")
        else:
            value = m.group("value")
            if m.group().startswith("Basic"):
                try:
                    good = ":" in base64.b64decode(value + "=" * (-len(value) % 4)).decode("utf-8")
                except (binascii.Error, ValueError):
                    good = False
            else:
                good = looks_secret(value)
            if good:
                yield Credential(m.start("value"), m.end("value"), "authorization")


# ---- configuration: key paths with offsets


def path_sensitivity(path: list[str]) -> int:
    own = sensitivity(path[-1]) if path else 0
    if own < 2 and len(path) > 1 and words_of(path[-1])[-1:] in (["value"], ["data"], ["plain"], ["val"], []):
        own = max(own, sensitivity(path[-2]))
    return own


def kind_of(name: str) -> str:
    words = set(words_of(name))
    if words & {"token", "tokens", "jwt", "bearer", "jeton"}:
        return "token"
    if words & _KEY_WORDS or "apikey" in words or "signing" in words or "hmac" in words:
        return "key"
    return "password"


# ---- scripts: string literals and the names that govern them

_COMMENT_SECRET = re.compile(
    r"(?i:\b(?:pass(?:word|wd|phrase|wort)?|pwd|pw|login|logins|credentials?|creds|secret|token|api[ _\-]?key|key|kennwort|contrase(?:ñ|n)a|clave|mot de passe|zugang)\b)[^\n:=/]{0,30}?(?:[:=]|\bis\b|\bist\b|\bes\b|\best\b)\s*(?:[\w.\-@]+\s*/\s*)?[\"'`]?([^\s\"'`,;]{6,})"
)


def _comment(text: str, low: int, high: int) -> Iterator[Credential]:
    for m in _COMMENT_SECRET.finditer(text, low, high):
        value = m.group(1).rstrip(".)")
        if looks_secret(value) and not re.match(r"^[\w.]+\(", value) and re.search(r"\d", value):
            yield Credential(m.start(1), m.start(1) + len(value), "password")


class _Strings:
    """Finds for each string of a script its governing name."""

    def __init__(self, scanner: Scanner):
        self.t, self.text = scanner.tokens, scanner.text

    def value(self, i: int) -> str:
        return self.t[i].value if 0 <= i < len(self.t) and self.t[i].kind in (NAME, PUNCT) else ""

    def kind(self, i: int) -> int:
        return self.t[i].kind if 0 <= i < len(self.t) else 0

    def literal(self, i: int) -> str:
        token = self.t[i]
        return self.text[token.start + 1 : token.end - 1]

    def plain(self, i: int) -> bool:
        """A string, or a template without holes that is closed."""
        if self.kind(i) != TEMPLATE:
            return self.kind(i) == STRING
        token = self.t[i]
        return token.end - token.start >= 2 and self.text[token.start] == "`" == self.text[token.end - 1]

    def runs(self) -> Iterator[tuple[int, int]]:
        """First and last token of each string or chain of strings joined by plus (or by a list's join)."""
        i = 0
        while i < len(self.t):
            if self.plain(i):
                j = i
                while self.value(j + 1) == "+" and self.plain(j + 2):
                    j += 2
                if j == i and self.value(i - 1) == "[":
                    k = i
                    while self.value(k + 1) == "," and self.plain(k + 2):
                        k += 2
                    if self.value(k + 1) == "]" and self.value(k + 2) == "." and self.value(k + 3) == "join":
                        j = k
                yield i, j
                i = j
            i += 1

    def names(self, i: int) -> list[str]:
        """Names that govern the string at i, the nearest first."""
        out: list[str] = []
        j = i - 1
        while j >= 0:
            v = self.value(j)
            if v in ("||", "??", "?", "|", "(", "["):
                if v == "(" and self.kind(j - 1) == NAME and self.value(j - 1) not in ("if", "while", "switch", "return"):
                    out.append("")
                j -= 1
                continue
            if v == ":" and self.value(j - 1) != ")":
                if self.kind(j - 1) in (NAME, STRING):
                    out.append(self.value(j - 1) or self.literal(j - 1))
                    return out
                if self.value(j - 1) == "]" and self.kind(j - 2) == STRING:
                    out.append(self.literal(j - 2))
                    return out
                j -= 1
                continue
            if v == "=":
                k = j - 1
                if self.value(k) == "]" and self.kind(k - 1) == STRING:
                    out.append(self.literal(k - 1))
                    return out
                # a type annotation may stand between
                while k > 0 and not (self.kind(k) == NAME and self.value(k - 1) in ("const", "let", "var", ".", ";", "}", "{", ",", "readonly", "private", "static", "public", "protected", "")):
                    k -= 1
                    if j - k > 8:
                        k = j - 1
                        break
                if self.kind(k) == NAME:
                    out.append(self.value(k))
                return out
            if v == "," and self.kind(j - 1) == STRING:  # an argument behind a name given as a string
                out.append(self.literal(j - 1))
                return out
            if v in (".",) or self.kind(j) == NAME and v not in ("return", "const", "let", "var", "await", "new", "case"):
                if self.kind(j) == NAME:
                    out.append(v)
                j -= 1
                continue
            return out
        return out


def script_credentials(text: str) -> list[Credential]:
    scanner = Scanner(text)
    strings = _Strings(scanner)
    found: list[Credential] = []
    tokens = scanner.tokens
    for i, j in strings.runs():
        low, high = tokens[i].start + 1, tokens[j].end - 1
        literal = strings.literal(i) if i == j else "".join(strings.literal(k) for k in range(i, j + 1) if strings.plain(k))
        if len(literal) < 6:
            continue
        hits = list(strong(text, low, high)) if i == j else []
        if i != j and any(True for _ in strong(literal)):
            hits = [Credential(low, high, "token")]
        if not hits and " " not in literal and not (literal.isalpha() and literal.islower()):
            names = [n for n in strings.names(i) if n]
            level = max((sensitivity(n) for n in names), default=0)
            if level == 2 and looks_secret(literal) or level == 1 and looks_secret(literal, strict=True):
                name = next(n for n in names if sensitivity(n) == level)
                hits = [Credential(low, high, kind_of(name))]
        found += hits
    # templates with holes, and what else is not a plain string
    for i, token in enumerate(tokens):
        if token.kind == TEMPLATE and not strings.plain(i):
            found += strong(text, token.start, token.end)
    for low, high in scanner.comments:
        found += strong(text, low, high)
        found += _comment(text, low, high)
    return found


def config_credentials(text: str, path: str) -> list[Credential]:
    found = list(strong(text))
    for keys, low, high in pairs_of(text, path):
        if high - low < 6 or any(c.start < high and low < c.end for c in found):
            continue
        level = path_sensitivity(keys)
        value = text[low:high]
        if level == 2 and looks_secret(value) or level == 1 and looks_secret(value, strict=True):
            found.append(Credential(low, high, kind_of(keys[-1])))
    comments = re.compile(r"(?m)^[ \t]*[#;][^\n]*$|[ \t]#[^\n]*$")
    if not path.lower().endswith(".json"):
        for m in comments.finditer(text):
            found += _comment(text, m.start(), m.end())
    return found


def credentials(text: str, path: str) -> list[Credential]:
    """Credentials of a file in order of position, none within another."""
    extension = path.rsplit(".", 1)[-1].lower()
    found = script_credentials(text) if extension in DIALECTS else config_credentials(text, path)
    out: list[Credential] = []
    for c in sorted(found, key=lambda c: (c.start, -c.end)):
        if not out or c.start >= out[-1].end:
            out.append(c)
    return out


def redacted(text: str, found: list[Credential]) -> str:
    """The text with each secret replaced by a mark of its kind, spliced into the original bytes.

    Quotes, line breaks and indentation stay, so the code around keeps its meaning and its line numbers.
    """
    raw = text.encode("utf-8", "surrogatepass")
    out, done, at = [], 0, 0
    for c in found:
        low = at + len(text[done : c.start].encode("utf-8", "surrogatepass"))
        secret = text[c.start : c.end]
        high = low + len(secret.encode("utf-8", "surrogatepass"))
        out += [raw[at:low], _mark(secret, c.kind).encode()]
        done, at = c.end, high
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def _mark(secret: str, kind: str) -> str:
    """A mark for a secret. Of one in pieces the quotes and operators between the pieces stay; of one over several
    lines each line keeps its indentation."""
    mark = f"REDACTED_{kind.upper()}"
    if "\n" in secret:
        return "\n".join(re.match(r"[ \t]*", line).group() + (mark if i == 0 else "*" * 8) + ("\r" if line.endswith("\r") else "") if line.strip() else line for i, line in enumerate(secret.split("\n")))
    pieces = re.split(r"([\"'`]\s*[+,]\s*[\"'`])", secret)
    return "".join(p if k % 2 else (mark if k == 0 else "") for k, p in enumerate(pieces))


def _located(text: str | None, path: str | None) -> dict:
    if text is None or path is None:
        return {"found": []}
    return {"found": [{"line_no": text.count("\n", 0, c.start) + 1, "kind": c.kind, "at": len(text[: c.start].encode("utf-8", "surrogatepass")), "length": len(text[c.start : c.end].encode("utf-8", "surrogatepass"))} for c in credentials(text, path)]}


def _spliced(text: str | None, path: str | None) -> dict:
    if text is None or path is None:
        return {"n_redacted": 0, "text": text}
    found = credentials(text, path)
    return {"n_redacted": len(found), "text": redacted(text, found) if found else text}


def located_credentials(files: DataFrame) -> DataFrame:
    """One row per credential: file, line, kind, and place in bytes of the text.

    Each file is read whole where it is stored; only the places are shuffled, to let the last of repeated deliveries
    hold. Null texts or paths give no rows, nor do empty texts; extra columns are ignored.
    """
    rows = per_file(files, _located, "found array<struct<line_no int, kind string, at int, length int>>", keep=["repo", "display_path"])
    return rows.select("file_id", "repo", "display_path", F.inline("found"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return located_credentials(table(spark, folder, "files")).select("file_id", "line_no").distinct()


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Each file with its credentials replaced; one that cannot be searched has no text, but an error."""
    return per_file(table(spark, folder, "files"), _spliced, "n_redacted int, text string", keep=["repo", "display_path"])


QUERIES = {"p5_found": p5_found, "p5_redacted": p5_redacted}
SQL: dict[str, str] = {}
