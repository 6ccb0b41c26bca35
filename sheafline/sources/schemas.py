"""Declared schemas of packets, pages and structured documents."""

from __future__ import annotations

BLOCK = "struct<text:string,x0:double,y0:double,x1:double,y1:double,block_type:string,font_size:double,is_heading:boolean>"
PAGE = (
    f"page_id string, packet_id string, page_number int, text string, blocks array<{BLOCK}>, width double, height double, text_length int, "
    "block_count int, image_count int, extraction_method string, metadata map<string,string>, warnings array<string>"
)
CONTENT_BLOCK = "struct<type:string,text:string,page:int,headers:array<string>,rows:array<array<string>>,items:array<string>,metadata:struct<bbox:array<double>,source_block_type:string,source_block_count:int>>"
SOURCE = "struct<packet_id:string,source_file:string,page_start:int,page_end:int>"
DOCUMENT = (
    f"document_id string, document_type string, confidence double, source {SOURCE}, "
    f"content struct<title:string,sections:array<struct<heading:string,page:int,blocks:array<{CONTENT_BLOCK}>>>>, "
    "metadata struct<packet_id:string,document_id:string,document_type:string,source_file:string,page_start:int,page_end:int,page_count:int,"
    "extraction_method:string,processing_timestamp:timestamp,content_hash:string,model_versions:map<string,string>,warnings:array<string>>"
)
CHUNK = "chunk_id string, document_id string, document_type string, page_start int, page_end int, section string, text string, block_type string, merged_label string"
STREAM_PAGE = "stream_id string, original_position int, boundary int, text string, source string, image binary"
EVIDENCE = "query_id string, document_id string, document_type string, page int, chunk_id string, evidence string, score double, vector_score double, rerank_score double"
