"""Errors of the index: all derive from FilePruneError."""


class FilePruneError(RuntimeError):
    """Base of the package's errors."""


def _error(name: str, text: str) -> type[FilePruneError]:
    return type(name, (FilePruneError,), {"__doc__": text, "__module__": __name__})


ColumnNotFoundException = _error("ColumnNotFoundException", "A column is neither in the schema nor an index alias.")
FileListNotFoundException = _error("FileListNotFoundException", "There is no such file list.")
FormatMismatchException = _error("FormatMismatchException", "An index is reopened with another format.")
IndexLockException = _error("IndexLockException", "A lock can't be had, or is no longer ours.")
IndexNotFoundException = _error("IndexNotFoundException", "There is no such index.")
IndexNotFoundInNewSchemaException = _error("IndexNotFoundInNewSchemaException", "An indexed column is missing in a new schema.")
MetadataMissingOrCorruptException = _error("MetadataMissingOrCorruptException", "An index's metadata can't be read.")
MissingFormatException = _error("MissingFormatException", "A new index needs a format.")
MissingSchemaException = _error("MissingSchemaException", "Stored metadata has no schema.")
SchemaMismatchException = _error("SchemaMismatchException", "An index is reopened with another schema.")
SchemaNotProvidedException = _error("SchemaNotProvidedException", "A new index needs a schema.")
SchemaParseException = _error("SchemaParseException", "A stored schema isn't one of columns.")
StorageMigrationException = _error("StorageMigrationException", "Storage can't be brought to the current format.")
UnsupportedMetadataVersionException = _error("UnsupportedMetadataVersionException", "Metadata were written by a later version.")
UnsupportedStorageFormatVersionException = _error("UnsupportedStorageFormatVersionException", "Storage was written by a later version.")
