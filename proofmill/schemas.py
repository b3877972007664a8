"""Explicit schemas of everything read or written; nothing is inferred. DDL, so that they need no session."""

DOC = "corpus string, doc_id string, media_type string, source struct<url: string, saved_at: timestamp, sha256: string>, thin boolean, ocr boolean"
PAGE = "corpus string, doc_id string, page_no int, char_start bigint, char_end bigint, text string, ocr boolean, image binary"
CLAIM = "answer_id string, question_no int, claim_id string, text string, kind string"
CITATION = "answer_id string, claim_id string, cite_id string, doc_id string, page_hint int, quote string, anchor string"
LEDGER = "answer_id string, cite_id string, doc_id string, page_no int, `start` bigint, `end` bigint, grade string, reasons array<string>, warnings array<string>"
SEARCH = "answer_id string, seq int, query string, purpose string"
GAP = "answer_id string, seq int, text string"
FIELD = "field string, value_pattern string, unlimited_pattern string"
CELL = "doc_id string, field string, state string, value string, sentence string, page_no int"
REGISTRY = "name string, root string, description string, generation bigint, updated_at timestamp"

QUESTION = "id string, domain string, question string, source string, source_url string, retrieved date, reference string, shape string, expect_authority string"
_QUESTION_FIELDS = "id domain question source source_url retrieved reference shape expect_authority".split()
QUESTION_FILE = f"about string, retrieved string, questions array<struct<{', '.join(f'{c}: string' for c in _QUESTION_FIELDS)}>>"
VERIFIER_OUT = ("citations bigint, verified bigint, failed bigint, warnings bigint, grades map<string, bigint>, searches array<struct<`for`: string>>, "
    "documents_in_corpus bigint, documents_cited bigint, ledger array<struct<doc: string>>")
ANSWER_FILE = ("question_no int, claims array<struct<id: string, text: string, kind: string, citations: array<struct<id: string, doc: string, page: int, quote: string, anchor: string>>>>, "
    "searches array<struct<query: string, `for`: string>>, gaps array<string>, _corrupt_record string")
VERIFIED_FILE = "verification struct<ledger: array<struct<doc: string>>>, gaps array<string>"
INDEX_FILE = "docs array<struct<id: string, source: struct<url: string>, thin: boolean>>"
JUDGMENT_FILE = "agrees_with_reference string, notes string"
SOURCES_FILE = "documents array<struct<url: string>>"
TRIGGER_FILE = "prompts array<struct<expect: string, prompt: string>>"
EVENT_LINE = "type string, message struct<content: array<struct<type: string, name: string, text: string, input: string>>>"
