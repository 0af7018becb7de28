"""Schemas of the tables that operators exchange (all keys are explicit: Spark rows have no order of their own)."""

from __future__ import annotations

#: One ranked list: for each query and route, keys with their owner, score and 1-based rank.
PATH = "qid string, route string, key bigint, owner string, score double, rank int"
#: A block of a parsed page, with its lines.
BLOCK = "doc_id bigint, block_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, lines array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>"
#: A chunk of a document, in reading order.
CHUNK = "doc_id bigint, chunk_id string, pos int, title_path array<string>, first_page int, last_page int, part int, parts int, text string"
#: A layout element of a converted document.
ELEMENT = "doc_id bigint, pos int, type string, page_idx int, text_level int, text string, caption array<string>, body string, footnote array<string>"
#: A metric record of the append-only evaluation log.
METRIC = "layer string, name string, metric string, value double, n bigint, note string, evidence_path string, at string"
#: A number found in a text.
NUMBER = "array<struct<raw:string,start:int,end:int,value:double,percent:boolean>>"
#: A cell of a projected table grid.
CELL = "array<array<string>>"
