"""Languages by path, name and alias; which paths are read at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id, tier (3: known without a grammar), aliases, file extensions, whole file names; the order decides.
LANGUAGES = [
    ("rust", 1, "rs rust", "rs", ""),
    ("javascript", 1, "js javascript node jsx mjs cjs", "js mjs cjs jsx", ""),
    ("typescript", 1, "ts tsx typescript", "ts mts cts tsx", ""),
    ("python", 1, "py pyi python python3", "py pyi pyw", ""),
    ("go", 1, "go golang", "go", ""),
    ("java", 2, "java", "java", ""),
    ("c", 2, "c h", "c h", ""),
    ("cpp", 2, "cpp c++ cxx cc hpp hh hxx", "cpp cc cxx c++ hpp hh hxx", ""),
    ("kotlin", 2, "kotlin kt kts", "kt kts", ""),
    ("sql", 2, "sql sequel", "sql", ""),
    ("shell", 2, "sh shell bash zsh fish shellscript", "sh bash zsh fish", ""),
    ("ruby", 2, "rb ruby", "rb", ""),
    ("php", 2, "php php3 php4 php5", "php phtml php3 php4 php5", ""),
    ("csharp", 2, "cs c# csharp", "cs", ""),
    ("scala", 2, "scala sc", "scala sc", ""),
    ("dart", 2, "dart", "dart", ""),
    ("lua", 2, "lua", "lua", ""),
    ("r", 2, "r rscript", "r rmd", ""),
    ("julia", 2, "jl julia", "jl", ""),
    ("perl", 3, "pl pm perl", "pl pm", ""),
    ("elixir", 2, "ex exs elixir", "ex exs", ""),
    ("haskell", 2, "hs haskell", "hs", ""),
    ("ocaml", 2, "ml mli ocaml", "ml mli", ""),
    ("zig", 2, "zig", "zig", ""),
    ("html", 2, "html htm xhtml", "html htm xhtml", ""),
    ("css", 2, "css", "css", ""),
    ("scss", 3, "scss sass", "scss", ""),
    ("xml", 3, "xml", "xml", ""),
    ("yaml", 2, "yml yaml", "yml yaml", ""),
    ("json", 2, "json jsonc", "json", ""),
    ("markdown", 2, "md markdown mdown mkd", "md markdown mdown mkd", ""),
    ("toml", 2, "toml", "toml", ""),
    ("proto", 2, "proto protobuf protocolbuffers", "proto", ""),
    ("terraform", 2, "tf tfvars terraform hcl", "tf tfvars", ""),
    ("hcl", 2, "hcl", "hcl", ""),
    ("powershell", 2, "ps1 psm1 powershell", "ps1 psm1", ""),
    ("batch", 3, "bat cmd batch", "bat cmd", ""),
    ("cmake", 2, "cmake", "cmake", "CMakeLists.txt"),
    ("make", 2, "make makefile gnumakefile", "mk mak make", "Makefile makefile GNUmakefile"),
    ("dockerfile", 3, "docker dockerfile", "dockerfile", "Dockerfile dockerfile"),
    ("swift", 2, "swift", "swift", ""),
    ("groovy", 3, "groovy gradle", "groovy gradle", ""),
    ("vue", 3, "vue", "vue", ""),
    ("svelte", 3, "svelte", "svelte", ""),
    ("racket", 3, "rkt racket", "rkt", ""),
    ("clojure", 3, "clj cljs clojure", "clj cljs", ""),
    ("erlang", 3, "erl hrl erlang", "erl hrl", ""),
    ("common-lisp", 3, "lisp cl el", "lisp el", ""),
    ("fortran", 3, "f f90 f77 fortran", "f90 f77 f", ""),
    ("text", 3, "txt text", "txt", ""),
]
#: Folders and file extensions that are never read.
SKIPPED = ("target", "node_modules", ".git")
BINARY = (
    "png", "jpg", "jpeg", "gif", "bmp", "webp", "ico", "icns", "tif", "tiff", "pdf", "zip", "gz",
    "tgz", "bz2", "xz", "zst", "7z", "rar", "jar", "war", "exe", "dll", "so", "dylib", "a", "o",
    "obj", "lib", "bin", "class", "pyc", "pyo", "wasm", "db", "sqlite", "sqlite3", "woff", "woff2",
    "ttf", "otf", "eot", "mp3", "mp4", "ogg", "wav", "flac", "avi", "mov", "webm", "mkv", "whl",
    "deb", "rpm", "dmg", "iso", "img", "parquet", "avro", "lockb",
)
#: Folders of deployment files.
DEPLOYMENT_DIRS = ("helm/", "charts/", "k8s/", "deploy/", "kubernetes/")


def languages(spark: SparkSession) -> DataFrame:
    """language, tier, kind (ext, file, alias), key: the first language of the registry for each way to name one."""
    seen: dict[tuple[str, str], tuple[str, int]] = {}
    for name, tier, alias, ext, files in LANGUAGES:
        for kind, values in (("ext", ext), ("file", files), ("alias", f"{name} {alias}")):
            for key in values.split():
                seen.setdefault((kind, key), (name, tier))
    rows = [(name, tier, kind, key) for (kind, key), (name, tier) in seen.items()]
    return spark.createDataFrame(rows, "language string, tier int, kind string, key string")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """The lower-cased extension; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1))


def _by(spark: SparkSession, kind: str, key: str, out: str) -> DataFrame:
    return F.broadcast(languages(spark).where(F.col("kind") == kind).select(F.col("key").alias(key), F.struct("language", "tier").alias(out)))  # some 70 rows


def detect_languages(files: DataFrame) -> DataFrame:
    """Files (path) with ``language`` and ``tier``: whole name first, then extension; null if unknown."""
    got = files.withColumn("__f", file_name(F.col("path"))).withColumn("__e", extension(F.col("path")))
    got = got.join(_by(files.sparkSession, "file", "__f", "lf"), "__f", "left").join(_by(files.sparkSession, "ext", "__e", "le"), "__e", "left")
    best = F.coalesce("lf", "le")
    return got.withColumn("language", best["language"]).withColumn("tier", best["tier"]).drop("__f", "__e", "lf", "le")


def languages_by_name(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``language`` (by id or alias, in any case) and ``grammar`` (whether it has one); null and false if unknown."""
    got = rows.withColumn("__n", F.lower(F.trim(F.col(name)))).join(_by(rows.sparkSession, "alias", "__n", "__l"), "__n", "left")
    return got.withColumn("language", F.col("__l.language")).withColumn("grammar", F.coalesce(F.col("__l.tier") != 3, F.lit(False))).drop("__n", "__l")


def is_skipped_path(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: s.isin(*SKIPPED))


def is_skipped(path: Column) -> Column:
    return is_skipped_path(path) | extension(path).isin(*BINARY)


def allowed_languages(files: DataFrame, allow: list[str]) -> DataFrame:
    """Files of the listed languages; an empty list allows all."""
    return files.where(F.col("language").isin(*allow)) if allow else files


def is_env_file(base: Column) -> Column:
    """Names of environment and property files."""
    ext = F.regexp_extract(base, r"\.([^.]*)$", 1)
    named = base.startswith(".env") | base.endswith(".env") | base.rlike(r"^(?:application|config)(?:$|[.-])") | (ext == "properties")
    return named & ext.isin("yml", "yaml", "properties", "env", "local", "")


def is_docs_path(lower: Column) -> Column:
    return lower.startswith("docs/") | lower.contains("/docs/")


def is_scannable(path: Column) -> Column:
    """Files whose text is evidence: readmes, env files, YAML, docs, API descriptions."""
    lower = F.lower(F.translate(path, "\\", "/"))
    base = file_name(lower)
    ext = F.regexp_extract(base, r"\.([^.]*)$", 1)
    doc = ext.isin("md", "markdown") & is_docs_path(lower)
    spec = (ext == "json") & base.rlike("openapi|swagger|asyncapi")
    return (base != "") & (base.startswith("readme") | is_env_file(base) | ext.isin("yml", "yaml") | doc | spec)
