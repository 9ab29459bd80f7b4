"""Settings: environment over file over defaults."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Folder:
    path: str
    label: str = ""


@dataclass(frozen=True)
class Settings:
    folders: tuple[Folder, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)
    values: dict[str, str] = field(default_factory=dict)

    def get(self, name: str, default: str = "") -> str:
        return self.values.get(name, default)


_ENTRY = re.compile(r"[^\n;|,]+")
# An entry: a label and "=" if there are any, then a path that may stand in quotes, up to a comment.
_FOLDER = re.compile(r"""^(?:(?P<label>[^=#]*)=)?\s*(?P<path>[^#]*?)\s*(?:\#.*)?$""", re.VERBOSE)
_SMB = re.compile(r"smb:[/\\]*", re.IGNORECASE)


def _local(path: str) -> str:
    """An absolute path; of a network address the form with two slashes, "" where nothing is left of it."""
    share, n = _SMB.subn("", path, count=1) if _SMB.match(path) else (path, 0)
    if n:
        path = "//" + share.replace("\\", "/") if share else ""
    return os.path.abspath(os.path.expanduser(path)) if path else ""


def parse_folders(text: str) -> list[Folder]:
    """label=path entries between newlines, semicolons, bars and commas; comments, quotes and smb: addresses are understood."""
    found = (_FOLDER.match(m[0].strip()) for m in _ENTRY.finditer(text))
    named = ((_local(m["path"].strip("\"'")), (m["label"] or "").strip()) for m in found if m)
    return [Folder(path, label) for path, label in named if path]


def parse_aliases(text: str) -> dict[str, str]:
    """host=alias entries, hosts regardless of case; comments and halves are passed over."""
    pairs = re.findall(r"(?:^|[\n;|,])[^\S\n]*([^\n;|,=#][^\n;|,=]*?)[^\S\n]*=[^\S\n]*([^\n;|,]*[^\s;|,])", text)
    return {host.lower(): alias for host, alias in pairs}


def _flat(tree: Mapping, prefix: str = "") -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in tree.items():
        name = f"{prefix}_{k}".strip("_").upper()
        if isinstance(v, Mapping):
            out |= _flat(v, name)
        elif isinstance(v, bool):
            out[name] = "1" if v else "0"
        elif isinstance(v, (list, tuple)):
            out[name] = ",".join(f"{x.get('label', '')}={x['path']}" if isinstance(x, Mapping) else str(x) for x in v)
        elif v is not None:
            out[name] = str(v)
    return out


def load(path: str | None, env: Mapping[str, str] | None = None, defaults: Mapping[str, str] | None = None) -> Settings:
    """A file that is named must exist; a blank variable counts as unset."""
    env = os.environ if env is None else env
    tree = {}
    if path is not None:
        if not Path(path).exists():
            raise FileNotFoundError(path)
        tree = json.loads(Path(path).read_text(encoding="utf-8"))
    values = dict(defaults or {}) | _flat(tree)
    values |= {k: v for k, v in env.items() if v.strip() and (k in values or k.startswith("SEARCH_"))}
    return Settings(tuple(parse_folders(values.get("SEARCH_FOLDERS", ""))), parse_aliases(values.get("SEARCH_FOLDER_ALIASES", "")), values)


def display_path(path: Column, aliases: Mapping[str, str]) -> Column:
    """The path with the host of a network address shown by its alias."""
    if not aliases:
        return path
    host = F.lower(F.regexp_extract(path, r"^(?:\\\\|//)([^\\/]+)", 1))
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    alias = F.try_element_at(table, host)
    return F.when((host != "") & alias.isNotNull(), F.concat(F.substring(path, 1, 2), alias, F.substring(path, F.length(host) + 3, F.length(path)))).otherwise(path)
