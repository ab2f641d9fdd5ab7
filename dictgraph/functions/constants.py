"""Fixed values that must equal the dictionary's conventions."""

# Collection names used in document handles.
TERMS = "terms"
BLOBS = "blobs"

# Edge predicates.
ENUM_OF = "_predicate_enum-of"
SECTION_OF = "_predicate_section-of"
BRIDGE_OF = "_predicate_bridge-of"

# Predicates an enumeration expansion walks; only the first two are emitted.
EXPAND_PREDICATES = (ENUM_OF, SECTION_OF, BRIDGE_OF)
EMITTED_PREDICATES = (ENUM_OF, SECTION_OF)

# Default traversal predicates of graph-aware resolution.
DEFAULT_TRAVERSE = (SECTION_OF, BRIDGE_OF)

# Language key of the English text fields.
ENGLISH = "ISO_639_3_eng"

# Identifier fields of the _code section that are matched exactly.
IDENTIFIER_FIELDS = ("_lid", "_nid", "_uri", "_aid", "_pid", "_name", "_symbol_print")

# Language-keyed text fields of the _info section, and the
# plain string-array fields searched with the same word tokenizer.
TEXT_LANG_FIELDS = ("_title", "_definition", "_description", "_examples", "_methods", "_uses", "_notes")
TEXT_ARRAY_FIELDS = ("_citation", "_provider", "_url")

# Language of text that belongs to no language: found whatever language is asked.
ANY_LANGUAGE = "any"

# Row status values (the request/response codes of the original service).
OK = "ok"
NOT_FOUND = "not_found"
NOT_OBJECT = "not_object"
MALFORMED = "malformed"
NOT_IN_GRAPH = "not_in_graph"
UNRESOLVED = "unresolved"

INBOUND = "inbound"
OUTBOUND = "outbound"
