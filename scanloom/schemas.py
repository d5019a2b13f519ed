"""Record schemas as DDL. Readers never infer."""

from __future__ import annotations

_list = "ARRAY<STRING>"
ANNOTATION = "field STRING, value STRING, bbox ARRAY<INT>, confidence DOUBLE"
ANNOTATION_FILE = f"MAP<STRING, STRUCT<image_id: STRING, image_path: STRING, annotations: ARRAY<STRUCT<{ANNOTATION}>>>>"
OCR_WORD = "image_id STRING, page_no INT, word_idx INT, text STRING, x INT, y INT, w INT, h INT, conf DOUBLE"
_ENTITIES = f"entities: STRUCT<dates: {_list}, amounts: {_list}, document_identifiers: {_list}, parties: STRUCT<sender: STRING, receiver: STRING>, contact_data: STRUCT<emails: {_list}, phone_numbers: {_list}>>"
REGEX_DOCUMENT = f"file_name STRING, pages INT, ground_truth STRUCT<gt_parse: STRUCT<{_ENTITIES}, language: STRING>, raw_text: STRING, metadata: STRUCT<document_type: STRING, processing_time: DOUBLE, timestamp: STRING>>"
_CONTENT = f"content: STRUCT<header: STRUCT<tax_office: STRING, date: STRING>, recipient: STRUCT<name: STRING, address: STRING>, tax_info: STRUCT<tax_number: STRING, id_number: STRING>, contact: STRUCT<phones: {_list}, emails: {_list}>>"
_RULE_ENTITIES = f"entities: STRUCT<dates: {_list}, document_ids: {_list}, phones: {_list}, emails: {_list}, organizations: {_list}, language: STRING>"
RULE_DOCUMENT = f"file_name STRING, pages INT, ground_truth STRUCT<gt_parse: STRUCT<{_CONTENT}, {_RULE_ENTITIES}>, raw_text: STRING, metadata: STRUCT<document_type: STRING, processing_time: STRING, bboxes_available: BOOLEAN>>"
PAGE_METADATA = f"source STRING, language STRING, raw_text STRING, metadata STRUCT<dates: {_list}, document_numbers: {_list}, emails: {_list}, phones: {_list}>"
CURATED = "doc_id STRING, ordinal INT, value STRING, suggested_name STRING, valid BOOLEAN, reason STRING"
REVIEW_ENTRY = "suggested_name STRING, confidence DOUBLE, original STRUCT<value: STRING>, translated_text STRING, needs_review BOOLEAN, user_correction STRING"
REVIEW_FILE = f"STRUCT<count: BIGINT, entries: ARRAY<STRUCT<{REVIEW_ENTRY}>>>"
TRAINING_ROW = "image_path STRING, language STRING, entities STRING"
