"""Paths, links and assets of documents. Paths are POSIX ones unless windows is set."""

from __future__ import annotations

import ntpath
import posixpath
import re
from urllib.parse import quote_plus

# File extensions of Markdown, and prefixes of links that leave the collection.
MARKDOWN_EXTENSIONS = ("md", "markdown", "mdown", "mkd", "mkdn", "mdwn", "mdtxt", "mdtext", "text", "rmd", "qmd", "mdx")
EXTERNAL = ("http://", "https://", "mailto:", "tel:", "ftp://")


def split_path(path: str) -> tuple[str, str, str]:
    """Folder (. if none), name and name without extension."""
    folder, name = re.match(r"(?s)^(?:(.*)[/\\])?([^/\\]*)$", path).groups()
    return folder or ("/" if path[:1] == "/" and folder == "" else "."), name, re.sub(r"\.[^.]*$", "", name)


def is_markdown(name: str) -> bool:
    m = re.search(r"\.([^./\\]*)$", name)
    return bool(m) and m[1].lower() in MARKDOWN_EXTENSIONS


def absolute(folder: str, path: str, windows: bool) -> str:
    if windows:
        path = path.replace("/", "\\")
        return path if ntpath.splitdrive(path)[0] and ntpath.isabs(path) else ntpath.normpath(ntpath.join(folder, path.lstrip("\\")))
    return path if path.startswith("/") else posixpath.normpath(posixpath.join(folder, path))


def classify_link(folder: str, href: str, windows: bool = False) -> tuple[str, str, str]:
    """Kind (normal, anchor, external, doc or open), resolved path and fragment of a link in a document of a folder."""
    if not href:
        return "normal", "", ""
    if href.startswith("#"):
        return "anchor", "", ""
    if href.lower().startswith(EXTERNAL):
        return "external", "", ""
    path, _, fragment = href.partition("#")
    path = path.partition("?")[0]
    if not path:
        return "anchor", "", ""
    path = absolute(folder, path, windows)
    return ("doc", path, fragment) if is_markdown(path) else ("open", path, "")


def resolve_asset(folder: str, source: str, windows: bool = False) -> str:
    """Source of an image: as it is where it is a URL, else a query for its file."""
    if not source or source.lower().startswith(("http://", "https://", "data:")):
        return source
    return "/asset?path=" + quote_plus(absolute(folder, source, windows), safe="~")
