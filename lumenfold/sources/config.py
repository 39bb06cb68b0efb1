"""Configuration: nested settings with defaults, read from and written to YAML or JSON files."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class DuplicateSettings:
    hash_threshold: int = 5
    embedding_threshold: float = 0.95
    ssim_threshold: float = 0.90
    enable_hash: bool = True
    enable_embedding: bool = True
    enable_ssim: bool = True


@dataclass(frozen=True)
class SearchSettings:
    index_type: str = "flat"
    cells: int = 16
    probes: int = 4
    max_results: int = 10
    similarity_threshold: float = 0.7


@dataclass(frozen=True)
class IndexSettings:
    batch_size: int = 32
    methods: tuple[str, ...] = ("embedding",)
    extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "bmp", "gif", "tiff", "webp")


@dataclass(frozen=True)
class Settings:
    duplicates: DuplicateSettings = field(default_factory=DuplicateSettings)
    search: SearchSettings = field(default_factory=SearchSettings)
    index: IndexSettings = field(default_factory=IndexSettings)
    catalog_dir: str = "catalog"

    @classmethod
    def load(cls, path: str = "config.yaml") -> Settings:
        """Settings of a file; what it doesn't say, and a missing file, leave the defaults.  A `system:` section is
        the same as the top level."""
        file = Path(path)
        if not file.exists():
            return cls()
        data = json.loads(file.read_text()) if file.suffix == ".json" else read_yaml(file.read_text())
        data = {**data, **(data.pop("system", None) or {})}
        return _filled(cls, data)

    def save(self, path: str) -> None:
        data = dataclasses.asdict(self)
        Path(path).write_text(json.dumps(data, indent=2) if path.endswith(".json") else write_yaml(data))


#: Named sets of thresholds: exact as the defaults, faster, and stricter.
PROFILES = {
    "default": Settings(),
    "performance": Settings(duplicates=DuplicateSettings(enable_ssim=False), search=SearchSettings(index_type="ivf")),
    "accuracy": Settings(duplicates=DuplicateSettings(hash_threshold=3, embedding_threshold=0.97, ssim_threshold=0.95)),
}


def _filled(kind, data: dict):
    values = {}
    for f in dataclasses.fields(kind):
        if f.name in data:
            default = getattr(kind(), f.name)
            given = data[f.name]
            values[f.name] = _filled(type(default), given or {}) if dataclasses.is_dataclass(default) else tuple(given) if isinstance(default, tuple) else type(default)(given)
    return kind(**values)


def write_yaml(data: dict, depth: int = 0) -> str:
    """Mappings, lists of plain values and plain values."""
    lines = []
    for k, v in data.items():
        pad = "  " * depth
        if isinstance(v, dict):
            lines.append(f"{pad}{k}:\n{write_yaml(v, depth + 1)}".rstrip("\n"))
        else:
            lines.append(f"{pad}{k}: {json.dumps(list(v) if isinstance(v, tuple) else v)}")
    return "\n".join(lines) + "\n"


def read_yaml(text: str) -> dict:
    """The part of YAML that write_yaml() writes, and block lists."""
    root: dict = {}
    stack: list[tuple[int, object]] = [(-1, root)]
    pending: tuple[dict, str] | None = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        indent, bare = len(bare) - len(bare.lstrip()), bare.strip()
        if bare.startswith("- "):
            if pending is not None:
                pending[0][pending[1]] = []
                stack.append((indent - 1, pending[0][pending[1]]))
                pending = None
            stack[-1][1].append(_plain(bare[2:]))
            continue
        while stack[-1][0] >= indent or isinstance(stack[-1][1], list):
            stack.pop()
        key, _, value = bare.partition(":")
        owner = stack[-1][1]
        if value.strip():
            owner[key.strip()] = _plain(value.strip())
            pending = None
        else:
            owner[key.strip()] = {}
            stack.append((indent, owner[key.strip()]))
            pending = (owner, key.strip())
    return root


def _plain(value: str):
    try:
        return json.loads(value)
    except ValueError:
        return {"True": True, "False": False, "null": None, "~": None}.get(value, value.strip("'\""))
