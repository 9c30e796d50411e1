"""Problem 2: files that nobody wrote by hand in their repository.

Output of tools, lock files, minified and bundled scripts and data stored as code are told by header and layout, one
file at a time. Copies of third-party code are told by Merkle hashes over directory trees: a hash per file, combined
bottom-up per directory, and subtrees that occur in unrelated repositories are copies. Banners and dependency folders
tell the copies that occur once.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.files import per_file
from sievework.llm.script_parser import DIALECTS
from sievework.shared import materialise, table

# A line of the leading comment that begins so speaks of this file. Fixed values, in four languages.
_GENERATED = re.compile(
    r"^\W*(?:@generated\b|<auto-?generated|(?:this (?:file|code|module|class) (?:is|was|has been) )?(?:auto(?:matically)?|machine)[\- ]?generated\b|(?:this (?:file|code|module) (?:is|was|has been) )?generated (?:by|from|with|using|on|at|automatically)\b|code generated\b|this (?:file|module) (?:is|was) (?:created|produced|written|emitted|built) by\b|(?:the )?output of (?:a |the )?(?:build|tool|compiler|generator|code)|compiled (?:from|by|with)\b|transpiled\b|(?:please )?do not (?:edit|modify|change)\b|edits? will be (?:lost|overwritten)|any changes? (?:is|are|will be) lost"
    r"|(?:diese datei (?:ist|wurde) )?automatisch (?:erzeugt|generiert|erstellt)|(?:diese datei )?(?:erzeugt|generiert|erstellt) (?:von|aus|mit|durch)\b|nicht (?:von hand|bearbeiten)|(?:ce )?fichier (?:produit|généré|genere|créé|cree)|(?:code )?généré (?:par|automatiquement)|ne pas (?:modifier|éditer)|(?:este )?archivo (?:creado|generado|producido)|(?:código )?generado (?:por|automáticamente)|no (?:editar|modificar))",
    re.I,
)
_BANNER = re.compile(
    r"^\W*(?:@license\b|@preserve\b|copyright\b.*|\(c\)\s.*|[\w.\-@/]+ v?\d+\.\d+\.\d+\S*\s*\|\s*(?:\(c\)|©|copyright|licen[sc]e|MIT).*|[\w.\-/]+@\d+\.\d+\.\d+\S*\s*$|upstream\s*:\s*\S+|licensed under\b.*|released under\b.*|vendored from\b.*|(?:copied|taken|adapted|imported) (?:verbatim )?from https?:.*|homepage\s*:\s*https?.*)",
    re.I | re.M,
)
_BANG = re.compile(r"^/\*!\s*[\w.\-@/]+ v?\d+\.\d+")
_DEPENDENCIES = re.compile(r"(?:^|/)(?:vendor|third[_\-]?party|thirdparty|external|externals|deps|node_modules|bower_components|jspm_packages|Pods)/")
_LOCK_NAME = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|composer\.lock|[\w.]+[\-.]lock\.(?:ya?ml|json)|bun\.lockb?|deno\.lock)$", re.I)
_LOCK_TEXT = re.compile(r"^[^\S\n]*[\"']?lockfile(?:Version|Format)[\"']?\s*:", re.M)
_PACKED = re.compile(r"__webpack_require__|/\*{6}/|\bparcelRequire\b|System\.register\(\[|^//# sourceMappingURL=", re.M)
_STRING_OR_COMMENT = re.compile(r"(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`)|/\*[\s\S]*?\*/|//[^\n]*")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`|\b0[xX][0-9a-fA-F]+|-?\b\d[\d.eE_]*")
_CONTROL = re.compile(r"\b(?:function|return|if|for|while|switch|try|await|class)\b|=>")
_EXTERNAL_SCRIPTS = re.compile(r"(?:^|/)(?:js|javascripts?|scripts|static|public)/(?:ext|external|libs?|plugins|vendors?)/")
# Wrappers and stamps of published builds: they serve loaders that a repository's own modules do not need.
_PUBLISHED = re.compile(r"\A\s*(?:[\"']use strict[\"'];?\s*)?(?:[;!+]?\(?function\s*\((?:root|global|window|self|globalThis)\s*,?\s*\w*\)\s*\{|(?:var|const|let) VERSION = [\"']\d+\.\d+\.\d+[\"'];)")


@lru_cache(maxsize=4)
def uncommented(text: str) -> str:
    """Text without comments; what looks like one in a string stays."""
    return _STRING_OR_COMMENT.sub(lambda m: m.group(1) or "", text)


def head_lines(text: str) -> list[str]:
    """Lines of the comments in front of the code, without comment marks."""
    out = []
    at = 1 if text.startswith("﻿") else 0
    skip = re.compile(r"\s*(?:#![^\n]*\n|//[^\n]*|/\*[\s\S]*?\*/|#[^\n]*|[\"']use strict[\"'];?)")
    while True:
        m = skip.match(text, at)
        if not m:
            return out
        at = m.end()
        out += [re.sub(r"^[\s/*#!]+|[\s*/]+$", "", line) for line in m.group().split("\n")]
    return out


def shapes(text: str) -> list[str]:
    """Lines of code with names, numbers and strings levelled."""
    out = []
    for line in uncommented(text).split("\n"):
        line = line.strip()
        if line:
            line = _LITERAL.sub("0", line)
            line = re.sub(r"[A-Za-z_$][\w$]*", "a", line)
            out.append(re.sub(r"(?:(?:a|0|a: ?0)[, ]+){2,}", "", line))
    return out


def is_numbered(text: str) -> bool:
    """Whether the exported names count up from 0, as names made by a generator do, and hardly anything else is there."""
    names = re.findall(r"^(?:export (?:const|interface|class|function|type|enum|declare \w+)|module\.exports\.|exports\.)\s*\w*?[A-Za-z_](\d+)\b", text, re.M)
    if len(names) < 4 or [int(n) for n in names] != list(range(len(names))):
        return False
    # hand-written code may number its names too, but its lines do not repeat
    lines = shapes(text)
    return len(set(lines)) <= 0.5 * len(lines)


def is_table(text: str) -> bool:
    """Whether nearly all of the code is literals: data stored as code."""
    code = uncommented(text)
    bare = "".join(code.split())
    if len(bare) < 400:
        return False
    literals = sum(len(m) for m in _LITERAL.findall(code))
    if literals < 0.5 * len(bare):
        return False
    # what is left of the code without literals, keys and separators
    rest = re.sub(r"[\w$]+\s*:|[,\[\]{}();]", " ", _LITERAL.sub("", code))
    return len(re.sub(r"\s+", "", rest)) < 0.06 * len(bare) + 60 and len(_CONTROL.findall(rest)) < 3


def is_message_map(text: str) -> bool:
    """Whether one object of equally shaped entries makes up the file, its keys being strings made by a tool."""
    lines = [x for x in uncommented(text).split("\n") if x.strip()]
    rows = [x for x in lines if re.match(r"\s*[\"'][^\"']+\.\d+[\"']\s*:\s*\[[^\]]*\],?\s*$", x)]
    return len(rows) >= 4 and len(rows) >= 0.5 * len(lines)


def is_minified(text: str) -> bool:
    """Whether most of the text stands in very long lines that hold many statements of short names.

    A hand-written file with a few long literals is none, since literals do not count."""
    code = _LITERAL.sub("0", uncommented(text))
    lines = [x for x in code.split("\n") if x.strip()]
    size = sum(map(len, lines))
    if size < 200:
        return False
    long = [x for x in lines if len(x) > 180]
    dense = sum(len(x) for x in long)
    if dense < 0.6 * size:
        return False
    joined = "".join(long)
    names = re.findall(r"[A-Za-z_$][\w$]*", joined)
    marks = len(re.findall(r"[;{}]", joined))
    blanks = joined.count(" ")
    return marks >= len(joined) / 60 and blanks < 0.16 * len(joined) and bool(names)


def own_marks(text: str, path: str) -> str | None:
    """Why a file is told by itself to be no hand-written source; null if nothing tells it."""
    extension = path.rsplit(".", 1)[-1].lower()
    script = extension in DIALECTS
    if _LOCK_NAME.search(path) or not script and len(text) > 200 and _LOCK_TEXT.search(text):
        return "lock"
    head = head_lines(text)
    if any(_GENERATED.match(line) for line in head):
        return "generated"
    if not script:
        return None
    if is_minified(text):
        return "minified"
    if _BANG.match(text.lstrip("﻿ \r\n")) or any(_BANNER.match(line) for line in head):
        return "vendored"
    if _DEPENDENCIES.search(path) or _EXTERNAL_SCRIPTS.search(path) or _PUBLISHED.match(uncommented(text).lstrip("﻿")):
        return "vendored"
    if is_table(text):
        return "data"
    if is_numbered(text) or is_message_map(text):
        return "generated"
    if _PACKED.search(text):
        return "bundled"
    return None


def leaf_hash(text: str) -> int:
    """Hash of a script without comments and white space, so that a banner, a licence or line ends do not matter."""
    bare = "".join(uncommented(text).lstrip("﻿").split())
    return int.from_bytes(hashlib.blake2b(bare.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _marks(text: str | None, path: str | None) -> dict:
    if text is None or path is None:
        return {"mark": None, "leaf": None, "weight": 0, "shown": path}
    script = path.rsplit(".", 1)[-1].lower() in DIALECTS
    bare = len("".join(uncommented(text).split())) if script else 0
    return {"mark": own_marks(text, path), "leaf": leaf_hash(text) if script and bare else None, "weight": bare, "shown": path}


def merkle_nodes(leaves: DataFrame) -> DataFrame:
    """Hashes of all files and directories of each repository, from the leaves up.

    ``leaves`` has (repo, path, hash, weight). A directory's hash is made of the sum and the exclusive-or of its
    children's mixed hashes, which does not depend on names or order and aggregates partially, so that a directory with
    very many files is never gathered. Returns (repo, path, depth, hash, weight); a file at the root has depth 1.
    """
    mixed = F.xxhash64("hash", F.lit("child"))
    level = leaves.select("repo", "path", F.size(F.split("path", "/")).alias("depth"), "hash", "weight")
    # leaves are filed by depth and every level is written, so that a step reads its own level and no plan holds others
    level = materialise(level, "merkle-leaves", by="depth")
    deepest = level.agg(F.max("depth")).first()[0] or 0
    nodes, pending = level, level.where(F.col("depth") == deepest)
    for depth in range(deepest, 1, -1):
        parents = pending.groupBy("repo", F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("path")).agg(
            F.xxhash64(F.sum(mixed.bitwiseAND(F.lit((1 << 40) - 1))), F.bit_xor(mixed), F.count(F.lit(1))).alias("hash"), F.sum("weight").alias("weight"), (F.max("depth") - 1).alias("depth")
        )
        parents = materialise(parents.select("repo", "path", "depth", "hash", "weight"), "merkle-level")
        nodes = nodes.unionByName(parents)
        pending = level.where(F.col("depth") == depth - 1).unionByName(parents)
    return nodes


#: Bare characters below which equal files and directories count as chance. A parameter of the operator.
LEAST_WEIGHT = 120
#: Into how many parts the copies of one hash are split where they look up who else holds it.
SALTS = 16


def _per_salt(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def shared_subtrees(nodes: DataFrame, least_weight: int = LEAST_WEIGHT, related: float = 0.5) -> DataFrame:
    """Nodes (repo, path) whose hash occurs in at least two unrelated repositories.

    A repository that shares most of its files with another is a relative of it (a fork or a mirror), and what only
    relatives share is no third-party code. Relatives are found without pairs of repositories: of each hash only the
    first repository that holds it is noted, and a repository is a relative of the one that is first for more than
    ``related`` of its files. Who holds a hash is an aggregate that combines first; only hashes of several repositories are
    joined back, and the copies of one hash are salted, so that a library in a million repositories meets in no one task.
    """
    heavy = nodes.where(F.col("weight") >= least_weight).withColumn("salt", F.pmod(F.xxhash64("repo", "path"), F.lit(SALTS)).cast("int"))
    holders = heavy.groupBy("hash").agg(F.min("repo").alias("first"), F.max("repo").alias("last")).where(F.col("first") != F.col("last"))
    files = heavy.join(_per_salt(holders), ["hash", "salt"])
    sizes = heavy.groupBy("repo").agg(F.count(F.lit(1)).alias("_all"))
    common = files.where(F.col("repo") != F.col("first")).groupBy("repo", "first").agg(F.count(F.lit(1)).alias("_common"))
    kin = common.join(sizes, "repo").where(F.col("_common") > related * F.col("_all")).select("repo", "first")
    # a relative counts as its original; what is left in one family only is not marked
    root = kin.groupBy("repo").agg(F.min("first").alias("family"))
    family = files.join(root, "repo", "left").withColumn("family", F.coalesce("family", "repo"))
    spread = family.groupBy("hash").agg(F.min("family").alias("_a"), F.max("family").alias("_b")).where(F.col("_a") != F.col("_b"))
    return files.join(_per_salt(spread.select("hash")), ["hash", "salt"], "left_semi").select("repo", "path", "depth")


def not_handwritten(files: DataFrame) -> DataFrame:
    """Per file that was not written by hand in its repository: (file_id, repo, display_path, reason).

    Texts are looked at where they are stored, and only hashes and marks are shuffled. The last of repeated deliveries
    holds. A file without text or path gives no row, and neither does an empty one. Equal files and equal directories
    count once per repository. Extra columns are ignored.
    """
    marks = materialise(per_file(files, _marks, "mark string, leaf long, weight long, shown string", keep=["repo"]), "file-marks")
    leaves = marks.where(F.col("leaf").isNotNull()).select("repo", F.col("shown").alias("path"), F.col("leaf").alias("hash"), "weight")
    shared = materialise(shared_subtrees(merkle_nodes(leaves)), "shared-subtrees")
    # a file lies in a shared subtree if it or one of its directories is a shared node
    above = F.expr("transform(sequence(1, size(split(shown, '/'))), i -> array_join(slice(split(shown, '/'), 1, i), '/'))")
    places = marks.where(F.col("mark").isNull() & F.col("leaf").isNotNull()).select("file_id", "repo", F.explode(above).alias("path"))
    copied = places.join(shared, ["repo", "path"], "left_semi").select("file_id").distinct().withColumn("_copied", F.lit(True))
    joined = marks.join(copied, "file_id", "left")
    reason = F.coalesce("mark", F.when(F.col("_copied"), F.lit("vendored")))
    return joined.select("file_id", "repo", F.col("shown").alias("display_path"), reason.alias("reason")).where(F.col("reason").isNotNull())


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return not_handwritten(table(spark, folder, "files")).select("file_id")


def p2_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the reason, and with what discovery notes about the path."""
    hints = table(spark, folder, "skipped_paths").groupBy("repo", F.col("path").alias("display_path")).agg(F.min("source").alias("skipped_by"))
    return not_handwritten(table(spark, folder, "files")).join(hints, ["repo", "display_path"], "left")


QUERIES = {"p2_found": p2_found, "p2_reasons": p2_reasons}
SQL: dict[str, str] = {}
