"""Fixed values that results depend on."""

# --- Fixed values: closed enumerations -------------------------------------
MEDIA_TYPES = ["image", "video", "audio", "document", "unknown"]
ASSET_TYPES = ["image", "video_frame", "text_chunk", "caption"]
COLLECTIONS = ["image_vectors", "video_frame_vectors", "caption_text_vectors"]
JOB_TYPES = [
    "scan_library", "probe_media", "index_media", "purge_video_index", "transcribe_audio",
    "embed_image", "embed_video_frame", "embed_text_asset", "generate_caption", "export_clip",
]
JOB_STATUSES = [
    "queued", "running", "succeeded", "failed", "cancel_requested", "cancelled", "stale",
]
INDEX_PROFILES = ["light", "balanced", "dense"]
LIBRARY_STATUSES = ["active", "disabled", "deleted"]
EMBEDDING_JOB_TYPES = ["embed_image", "embed_video_frame", "embed_text_asset"]
ATTEMPTED_STATUSES = ["queued", "running", "failed", "succeeded"]
INDEX_JOB_TYPES = [
    "index_media", "purge_video_index", "embed_image", "embed_video_frame",
    "embed_text_asset", "generate_caption",
]

# --- Fixed values: file extensions ------------------------------------------
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "gif", "heic", "tif", "tiff"]
VIDEO_EXTENSIONS = ["mp4", "mov", "m4v", "mkv", "avi", "webm"]
AUDIO_EXTENSIONS = ["mp3", "wav", "m4a", "flac", "aac", "ogg"]
DOCUMENT_EXTENSIONS = ["txt", "md", "pdf", "srt", "vtt"]
CONTENT_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif",
    "webp": "image/webp", "avif": "image/avif",
    "mp4": "video/mp4", "mov": "video/quicktime", "m4v": "video/x-m4v", "webm": "video/webm",
    "mp3": "audio/mpeg", "wav": "audio/wav", "m4a": "audio/mp4", "flac": "audio/flac",
    "ogg": "audio/ogg",
}
DEFAULT_CONTENT_TYPES = {"image": "image/jpeg", "video": "video/mp4", "audio": "audio/mpeg"}
OCTET_STREAM = "application/octet-stream"

# --- Fixed values: vector collections and models ----------------------------
VISUAL_MODEL = ("google/siglip-base-patch16-224", "siglip-base-patch16-224", 768)
CAPTION_MODEL = (
    "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2",
    "paraphrase-multilingual-MiniLM-L12-v2",
    384,
)
COLLECTION_REGISTRY = {
    "image_vectors": {
        "vector_kind": "image_embedding", "model": VISUAL_MODEL, "media_types": ["image"],
        "job_type": "embed_image",
    },
    "video_frame_vectors": {
        "vector_kind": "frame_embedding", "model": VISUAL_MODEL, "media_types": ["video"],
        "job_type": "embed_video_frame",
    },
    "caption_text_vectors": {
        "vector_kind": "vlm_caption_text_embedding", "model": CAPTION_MODEL,
        "media_types": ["image", "video"], "job_type": "embed_text_asset",
    },
}
DISTANCE = "Cosine"
CAPTION_VLM = ("Qwen/Qwen2.5-VL-7B-Instruct", "qwen2.5-vl-7b-instruct")
POINT_NAMESPACE = "f3f4e35a-688d-4f79-99e0-91f9480a5827"
IMAGE_PROMPT = "caption-v1"
SCENE_PROMPT = "scene-caption-v2"
SUPERSEDED_REASON = "superseded_by_scene_caption_v2"
DEFAULT_PROFILE = "balanced"

# --- Fixed values: search ----------------------------------------------------
TEXT_CHANNEL = "text_search"
CAPTION_CHANNEL = "caption_text_vectors"
GROUPED_CHANNEL = "video_frame_vectors"
REASONS = ["vector_match", "transcript_match", "caption_match"]
PRIMARY_REASON_ORDER = ["transcript_match", "caption_match", "vector_match"]
VECTOR_WEIGHT = 0.55
TEXT_WEIGHT = 0.45
MULTI_SIGNAL_BONUS = 0.08
MIN_SOURCE_SCORE = 0.1
RRF_K = 60
RRF_SIGNALS = ["visual", "caption", "lexical"]
MIN_SOURCE_LIMIT = 30
MAX_SOURCE_LIMIT = 300
OVERFETCH = 3
COVER_WEIGHT = 0.1
DEFAULT_VARIANT_WEIGHT = 0.85
MIN_VARIANT_WEIGHT = 0.1
MAX_DIAGNOSTIC_FRAMES = 5

# --- Fixed values: temporal indexing -----------------------------------------
SCENE_MIN_SECONDS = 0.5
SCENE_MAX_SECONDS = 30.0
SCENE_MAX_COUNT = 2000
SCENE_THRESHOLD = 27.0
FRAME_INTERVAL_SECONDS = 2.5
LAYOUT_VERSION = "scene-frames-v3"
BOUNDARY_TOLERANCE = 1e-6
CHUNK_MIN_SECONDS = 15.0
CHUNK_MAX_SECONDS = 30.0
CAPTION_MAX_FRAMES = 6
CAPTION_TIMEOUT_SECONDS = 7200
TRANSCRIBE_TIMEOUT_SECONDS = 14400

# --- Fixed values: gates ------------------------------------------------------
GIBIBYTE = 1024**3
MAX_PEAK_SWAP_GROWTH = 4 * GIBIBYTE
MAX_END_SWAP_GROWTH = 1 * GIBIBYTE
GATE_CLIP_SECONDS = 30.0
GATE_MAX_LATENCY = 60.0
GATE_MAX_TOP3_TOTAL = 180.0
REQUIRED_TAGS = [
    "transient_action", "person_relationship", "environment_constraint",
    "single_hand_peace_sign",
]
REQUIRED_DURATIONS = [5.0, 15.0, 30.0]
MIN_BENCHMARK_CASES = 10
STRICT_RESPONSE_KEYS = [
    "relevance", "matched_constraints", "missing_constraints", "reason",
]

# --- Fixed values: display labels ---------------------------------------------
LABELS = {
    "media_type": {
        "image": "图片", "video": "视频", "audio": "音频", "document": "文档", "unknown": "未知",
    },
    "collection": {
        "image_vectors": "图片向量", "video_frame_vectors": "视频帧向量",
        "caption_text_vectors": "Caption 文本向量",
    },
    "score_kind": {
        "cosine_similarity": "余弦相似度", "hybrid_score": "混合排序分", "ts_rank_cd": "全文检索分",
    },
    "reason": {
        "vector_match": "视觉命中", "transcript_match": "转写命中", "caption_match": "Caption 命中",
    },
    "job_type": {
        "scan_library": "扫描素材库", "probe_media": "探测媒体", "index_media": "索引媒体",
        "generate_caption": "生成 Caption", "embed_text_asset": "文本向量化", "export_clip": "导出片段",
    },
    "status": {
        "queued": "等待中", "running": "运行中", "succeeded": "已完成", "failed": "失败",
        "indexed": "已索引", "pending": "待处理", "probed": "已探测",
    },
    "asset_type": {
        "image": "图片资产", "video_frame": "视频帧", "text_chunk": "转录文本", "caption": "Caption 文本",
    },
}
CONFIDENCE_LOW, CONFIDENCE_OTHER = "相关性较弱", "高相关"
