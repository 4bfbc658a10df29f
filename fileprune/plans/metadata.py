"""What is stored about an index, as one JSON document."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from fileprune.errors import MetadataMissingOrCorruptException, MissingSchemaException, SchemaParseException, UnsupportedMetadataVersionException, UnsupportedStorageFormatVersionException

METADATA_VERSION, STORAGE_VERSION = 10, 4


@dataclass
class IndexMetadata:
    format: str
    schema: str
    read_options: dict[str, str] = field(default_factory=dict)
    indexes: list[str] = field(default_factory=list)
    bloom: dict[str, float] = field(default_factory=dict)
    computed: dict[str, str] = field(default_factory=dict)
    temporal: dict[str, str] = field(default_factory=dict)
    range: list[str] = field(default_factory=list)
    exploded: list[dict[str, str]] = field(default_factory=list)
    auto_bloom: list[str] = field(default_factory=list)
    built: list[str] = field(default_factory=list)
    total_size: int = -1
    batches_since_compact: int = 0
    #: What a document holds besides; it is kept.
    extra: dict = field(default_factory=dict)
    metadata_version: int = METADATA_VERSION
    storage_format_version: int = STORAGE_VERSION

    @classmethod
    def parse(cls, text: str) -> IndexMetadata:
        """Missing fields of earlier versions get their defaults, unknown ones are kept; format and schema must be there."""
        try:
            raw = json.loads(text)
            known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__ and v is not None}
            if "format" not in known or "schema" not in known:
                raise KeyError("format or schema")
            meta = cls(**known)
            meta.extra = {k: v for k, v in raw.items() if k not in cls.__dataclass_fields__} | known.get("extra", {})
        except (ValueError, TypeError, KeyError, AttributeError) as e:
            raise MetadataMissingOrCorruptException(str(e)) from e
        if meta.metadata_version > METADATA_VERSION:
            raise UnsupportedMetadataVersionException(str(meta.metadata_version))
        if meta.storage_format_version > STORAGE_VERSION:
            raise UnsupportedStorageFormatVersionException(str(meta.storage_format_version))
        meta.metadata_version = METADATA_VERSION
        return meta

    def dump(self) -> str:
        body = asdict(self)
        return json.dumps(body.pop("extra") | body, indent=1, sort_keys=True)

    def schema_json(self) -> dict:
        if not self.schema:
            raise MissingSchemaException("the index has no stored schema")
        try:
            parsed = json.loads(self.schema)
        except ValueError as e:
            raise SchemaParseException(str(e)) from e
        if not isinstance(parsed, dict) or parsed.get("type") != "struct":
            raise SchemaParseException("the stored schema isn't a struct")
        return parsed

    def struct(self) -> T.StructType:
        return T.StructType.fromJson(self.schema_json())

    def aliases(self) -> list[str]:
        return [x["as_column"] for x in self.exploded]

    def kinds(self) -> dict[str, str]:
        """Indexed name -> kind of index."""
        out = {c: "regular" for c in self.indexes} | {c: "bloom" for c in self.bloom} | {c: "computed" for c in self.computed}
        return out | {c: "temporal" for c in self.temporal} | {c: "range" for c in self.range} | {c: "exploded" for c in self.aliases()}

    def storage_columns(self) -> dict[str, str]:
        """Indexed name -> name in storage."""
        prefix = {"bloom": "bloom_", "range": "range_"}
        return {c: prefix.get(kind, "") + c for c, kind in self.kinds().items()}

    def valued(self) -> list[str]:
        """Names that have a list of values for each file."""
        return [c for c, kind in self.kinds().items() if kind not in ("bloom", "range")]
