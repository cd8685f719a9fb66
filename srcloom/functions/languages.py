"""Extension, language and target look-ups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from srcloom.functions import text as T

# Extension to language for the analyser.
ANALYSER_LANGUAGES = {
    ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp",
    ".cob": "cobol", ".cbl": "cobol",
    ".java": "java",
    ".rs": "rust",
}

# The extensions each kind of scan keeps.
PROFILES = {
    "analyser": list(ANALYSER_LANGUAGES),
    "java": [".java"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".h", ".c"],
    "validator": [".rs", ".cpp", ".c", ".java", ".cob"],
    "folder": [
        ".java", ".php", ".html", ".htm", ".js", ".cpp", ".c", ".h",
        ".cob", ".cbl", ".py", ".rb", ".cs", ".vb", ".pl", ".pas",
    ],
}

# Languages, and suggested targets, of the folder loader.
FOLDER_LANGUAGES = {
    ".java": "java7", ".php": "php", ".html": "html", ".htm": "html", ".js": "html",
    ".cpp": "cpp", ".c": "cpp", ".h": "cpp", ".cob": "cobol", ".cbl": "cobol",
    ".py": "python",
}
FOLDER_TARGETS = {
    "java7": "python", "php": "python", "html": "react", "cpp": "rust", "cobol": "rust",
}
DEFAULT_TARGET = "python"

# Extension written for a target language.
TARGET_EXTENSIONS = {
    "rust": ".rs", "java17": ".java", "python": ".py", "react": ".jsx", "vue3": ".vue",
    "svelte": ".svelte",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    """Constant map look-up; null when the key is unknown."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def extension(path: Column) -> Column:
    return F.lower(T.suffix(path))


def language_of_path(path: Column) -> Column:
    return F.coalesce(lookup(ANALYSER_LANGUAGES, extension(path)), F.lit("unknown"))


def in_profile(path: Column, profile: str) -> Column:
    return extension(path).isin(PROFILES[profile])
