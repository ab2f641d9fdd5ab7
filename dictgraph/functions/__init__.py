from dictgraph.functions.keys import handle, key_of, blob_key, strip_collection
from dictgraph.functions.variant import has_field, is_array, is_object, is_string, is_truthy
from dictgraph.functions.tokens import segment_tokens, word_tokens

__all__ = [
    "handle",
    "key_of",
    "blob_key",
    "strip_collection",
    "has_field",
    "is_array",
    "is_object",
    "is_string",
    "is_truthy",
    "segment_tokens",
    "word_tokens",
]
