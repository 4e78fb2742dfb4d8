"""Names, sets and formats that results depend on."""

# Source suffixes that are scanned.
SOURCE_EXTENSIONS = ("java", "sql", "php", "js")

# Words that set the operation of the names after them.
READ_KEYWORDS = ("FROM", "JOIN")
MODIFY_KEYWORDS = ("INSERT", "UPDATE", "DELETE", "MERGE")

# Object types a catalog row may have.
KNOWN_OBJECT_TYPES = (
    "TABLE", "VIEW", "MATERIALIZED VIEW", "PROCEDURE", "FUNCTION", "TRIGGER", "SEQUENCE", "SYNONYM",
    "TYPE", "TYPE BODY", "PACKAGE", "PACKAGE BODY", "INDEX", "CONSTRAINT", "GRANT", "JOB",
)

# Object types kept when names are matched, by report. The first two spell the
# materialized view with an underscore, which no catalog row has, so they leave such views out.
CODE_MAP_TYPES = (
    "TABLE", "VIEW", "SYNONYM", "PROCEDURE", "PACKAGE", "TRIGGER", "FUNCTION", "MATERIALIZED_VIEW",
)
OBJECT_MAP_TYPES = (
    "TABLE", "VIEW", "PROCEDURE", "PACKAGE", "TRIGGER", "FUNCTION", "MATERIALIZED_VIEW",
)
REFERENCES_TYPES = (
    "TABLE", "VIEW", "PROCEDURE", "PACKAGE", "TRIGGER", "FUNCTION", "MATERIALIZED VIEW",
)
TYPE_PRESETS = {
    "code_map": CODE_MAP_TYPES,
    "object_map": OBJECT_MAP_TYPES,
    "references": REFERENCES_TYPES,
}

# Object types that hold rows, most wanted first.
RELATION_TYPES = ("TABLE", "VIEW", "MATERIALIZED VIEW")

# Catalog kinds by object type.
CATALOG_KINDS = {
    "TABLE": "tables",
    "VIEW": "views",
    "PACKAGE": "packages",
    "PROCEDURE": "procedures",
    "FUNCTION": "functions",
    "TRIGGER": "triggers",
    "SEQUENCE": "sequences",
    "SYNONYM": "synonyms",
    "TYPE": "types",
    "MATERIALIZED VIEW": "materialized_views",
    "INDEX": "indexes",
    "CONSTRAINT": "constraints",
    "GRANT": "grants",
}

# Relationship kinds of an edge.
RELATIONSHIPS = (
    "read", "modify", "call", "entity_def", "repository_def", "repository_method_def",
    "repository_method_invocation",
)

# Report headings.
REPORT_HEADINGS = (
    ("owner", "Owner"), ("object_name", "Object Name"), ("object_type", "Object Type"),
    ("line", "Line"), ("line_number", "Line Number"), ("file_path", "File Path"),
    ("file_name", "File Name"), ("repo_name", "Repo Name"),
)

# Java types whose variables are followed.
STRING_TYPES = ("String", "StringBuilder")

# Repository methods that change data.
MODIFY_METHODS = (
    "save", "saveAll", "flush", "delete", "deleteByIs", "deleteAllByIs", "deleteAllByIsIn",
    "deleteAllByIsNotIn", "deleteInBatch", "deleteInAllBatch",
)

# Repository methods that read data.
QUERY_METHODS = (
    "findById", "findByIds", "findByIdIn", "findByIdNotIn",
    "findAll", "findAllById", "findAllByIdIn", "findAllByIdNotIn",
    "findAllByIs", "findAllByIsIn", "findAllByIsNotIn",
    "findAllByIsOrderBy", "findAllByIsInOrderBy", "findAllByIsNotInOrderBy",
    "findAllByIsOrderByDesc", "findAllByIsInOrderByDesc", "findAllByIsNotInOrderByDesc",
    "findAllByIsOrderByAsc", "findAllByIsInOrderByAsc", "findAllByIsNotInOrderByAsc",
    "findAllByIsNot", "findAllByIsNotOrderBy", "findAllByIsNotOrderByDesc", "findAllByIsNotOrderByAsc",
    "findAllByIsNotAndIsNot", "findAllByIsNotInAndIsNotIn",
    "findAllByIsNotAndIsNotOrderBy", "findAllByIsNotInAndIsNotInOrderBy",
    "findAllByIsNotAndIsNotOrderByDesc", "findAllByIsNotInAndIsNotInOrderByDesc",
    "findAllByIsNotAndIsNotOrderByAsc", "findAllByIsNotInAndIsNotInOrderByAsc",
    "findAllByIsNotAndIsNotAndIsNot", "findAllByIsNotInAndIsNotInAndIsNotIn",
    "findAllByIsNotAndIsNotAndIsNotOrderBy", "findAllByIsNotInAndIsNotInAndIsNotInOrderBy",
    "findAllByIsNotAndIsNotAndIsNotOrderByDesc", "findAllByIsNotInAndIsNotInAndIsNotInOrderByDesc",
    "findAllByIsNotAndIsNotAndIsNotOrderByAsc", "findAllByIsNotInAndIsNotInAndIsNotInOrderByAsc",
    "findAllByIsNotAndIsNotAndIsNotAndIsNot", "findAllByIsNotInAndIsNotInAndIsNotInAndIsNotIn",
    "findAllByIsNotAndIsNotAndIsNotAndIsNotOrderBy",
    "findAllByIsNotInAndIsNotInAndIsNotInAndIsNotInOrderBy",
    "findAllByIsNotAndIsNotAndIsNotAndIsNotOrderByDesc",
    "findAllByIsNotInAndIsNotInAndIsNotInAndIsNot",
    "existsById", "existsByIdIn", "existsByIdNotIn",
    "count", "countById", "countByIdIn", "countByIdNotIn",
    "countByIs", "countByIsIn", "countByIsNotIn", "countByIsNot",
    "existsByIs", "existsByIsIn", "existsByIsNotIn",
)

# Annotations by what they declare. A name may be in several classes.
QUERY_ANNOTATIONS = ("Query", "NamedQuery", "NamedNativeQuery")
CALL_ANNOTATIONS = (
    "Procedure", "Function", "NamedStoredProcedureQuery", "NamedStoredProcedureQueries",
)
MODIFY_ANNOTATIONS = (
    "Modifying", "Transactional", "TransactionalEventListener", "TransactionalEventListenerFactory",
)
ENTITY_ANNOTATIONS = (
    "Entity", "Embeddable", "MappedSuperclass", "Table", "SecondaryTable", "SecondaryTables",
    "Inheritance", "DiscriminatorColumn", "DiscriminatorValue", "ExcludeDefaultListeners",
    "ExcludeSuperclassListeners", "EntityListeners", "EntityResult", "FieldResult",
    "ConstructorResult", "SqlResultSetMapping", "NamedEntityGraph", "NamedEntityGraphs",
    "NamedAttributeNode", "NamedSubgraph", "NamedSubgraphs", "NamedNativeQueries",
    "NamedNativeQuery", "NamedQueries", "NamedQuery", "SqlResultSetMappings", "Convert", "Converter",
    "Converts", "Version", "Id", "EmbeddedId", "GeneratedValue", "Column", "Temporal", "Enumerated",
    "Lob", "Basic", "Transient", "Access", "Embedded", "ElementCollection", "CollectionTable",
    "MapKeyColumn", "MapKeyClass", "MapKeyTemporal", "MapKeyEnumerated", "MapKeyLob", "MapKeyBasic",
    "OrderColumn", "AttributeOverrides", "AttributeOverride", "AssociationOverrides",
    "AssociationOverride", "AttributeAccessor",
)
ANNOTATION_CLASSES = {
    "QUERY": QUERY_ANNOTATIONS,
    "CALL": CALL_ANNOTATIONS,
    "MODIFY": MODIFY_ANNOTATIONS,
    "ENTITY": ENTITY_ANNOTATIONS,
}

# What windows-1252 puts at bytes 80 to 9F; U+FFFD stands for the five bytes without a character.
CP1252_HIGH = bytes(range(0x80, 0xA0)).decode("windows-1252", "replace")
