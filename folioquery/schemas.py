"""Fixed schemas of the store's tables, and its kinds."""

VERSION = 4
BLOCK_TYPES = ("text", "heading", "image", "list", "table", "custom")
FORMATS = ("pdf", "docx", "customdata")
MODES = ("hybrid", "keyword", "semantic")
EMBEDDABLE = ("text", "heading", "custom")

BBOX = "struct<x:double,y:double,width:double,height:double,page_width:double,page_height:double>"
FONT = "struct<name:string,size:double,bold:boolean,italic:boolean>"
DOCUMENTS = "document_id string, name string, original_path string, format string, size_bytes long, page_count int, checksum string, content_hash string, created_at timestamp, updated_at timestamp, source string, description string, imported_at timestamp, external_id string"
BLOCKS = f"document_id string, block_id string, type string, content string, page int, sequence int, bbox {BBOX}, font {FONT}, is_heading boolean, heading_level int, section string, keywords array<string>, context string, children array<string>, entry_metadata map<string,string>"
POSTINGS = "term string, document_id string, block_id string, positions array<int>, tf double, block_len int"
DOC_STATS = "document_id string, total_terms long, unique_terms long, avg_block_length double"
VECTORS = "document_id string, block_id string, chunk_idx int, vector array<float>, text_hash string, model string, dimension int, created_at timestamp"
IMAGES = "image_id string, document_id string, block_id string, format string, width int, height int, page int, original_name string, description string, data binary"
TAGS = "document_id string, tag_key string, tag_value string"
ENTRIES = "source string, name string, description string, tags map<string,string>, external_id string, imported_at timestamp, entries array<struct<id:string,content:string,type:string,metadata:map<string,string>>>"
