"""All registries of this subpackage."""

from attestry.llm import queries_names, queries_records, queries_texts

REGISTRIES = (queries_names.REG, queries_records.REG, queries_texts.REG)
