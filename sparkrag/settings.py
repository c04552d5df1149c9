"""Defaults of the operators and fixed word lists."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_target_tokens: int = 512
    chunk_overlap_tokens: int = 64
    embed_dim: int = 384
    embed_batch: int = 32
    top_k: int = 6
    candidates: int = 24
    min_score: float = 0.05
    dense_weight: float = 0.6
    keyword_weight: float = 0.4
    rrf_k: int = 60
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    title_bonus: float = 1.5
    weight_bm25: float = 0.7
    weight_fusion: float = 0.3
    rerank_top_n: int = 0
    max_context_chars: int = 6000
    extractive_threshold: float = 0.55
    extractive_margin: float = 0.10
    answer_max_chars: int = 600
    web_min_relevance: float = 0.34
    web_min_results: int = 1
    web_max_results: int = 5
    rate_limit_per_minute: int = 120
    rate_limit_burst: int = 0
    max_upload_bytes: int = 100 * 1024 * 1024
    max_page_bytes: int = 200_000


DEFAULTS = Settings()

# What results depend on must be exactly these.

#: Function words that carry no meaning for retrieval, Indonesian then English.
STOPWORDS = (
    "ada", "adalah", "agar", "akan", "anda", "atau", "bagi", "bahwa", "bila", "bisa", "dalam", "dan", "dapat", "dari", "dengan", "di", "dia", "ini", "itu",
    "jika", "juga", "karena", "ke", "lagi", "maka", "maupun", "memang", "namun", "oleh", "pada", "para", "per", "secara", "sebagai", "sebuah", "sedang",
    "seperti", "serta", "setelah", "sudah", "supaya", "telah", "tentang", "tersebut", "terhadap", "untuk", "yaitu", "yang",
    "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "in", "into", "is", "it", "its", "of", "on", "or", "that", "the",
    "their", "then", "there", "these", "this", "to", "was", "were", "which", "will", "with",
)
#: Words that a web query's terms leave out.
QUERY_STOPWORDS = (
    "apa", "siapa", "kapan", "dimana", "mana", "bagaimana", "mengapa", "kenapa", "di", "ke", "dari", "yang", "dan", "atau", "itu", "ini", "adalah", "akan",
    "untuk", "dengan", "pada", "dalam", "tentang", "sebuah", "para", "juga",
    "the", "a", "an", "of", "to", "is", "are", "how", "what", "why", "when", "where", "which", "and", "or", "for", "with", "about",
)
#: Words that keyword variants of a query leave out.
KEYWORD_STOPWORDS = (
    "yang", "dan", "atau", "di", "ke", "dari", "untuk", "pada", "ini", "itu", "ada", "apa", "hal", "saat", "jika", "maka", "bisa", "akan", "sudah", "juga",
    "dengan", "oleh", "atas", "bagi", "agar", "kami", "kita", "saya", "anda", "mereka",
    "the", "and", "or", "in", "to", "from", "for", "at", "is", "a", "an", "by", "with", "of", "as", "it", "be", "its", "are",
)
#: Phrases of a question that say nothing of its subject.
META_PHRASES = (
    r"\bcarikan\b", r"\bcarilah\b", r"\btolong\b", r"\bmohan\b", r"\bberikan\b", r"\bdi\s+internet\b", r"\bdi\s+web\b", r"\bsaya\s+mau\s+tahu\b",
    r"\bsaya\s+ingin\s+tahu\b", r"\bi\s+want\s+to\s+know\b", r"\bplease\s+find\b", r"\bfind\s+me\b", r"\bsearch\s+for\b", r"\btell\s+me\b", r"\bapakah\b",
    r"\badakah\b", r"\bapa\s+saja\b",
)
#: The first two synonyms of each term are used.
SYNONYMS = {
    "biaya": ("harga", "tarif"),
    "cuti": ("libur", "liburan"),
    "kesehatan": ("medis", "kesek"),
    "kendaraan": ("mobil", "motor"),
    "gaji": ("upah", "salary"),
    "kantor": ("lokasi kerja", "tempat kerja"),
    "pertemuan": ("rapat", "meeting"),
    "proyek": ("project", "pekerjaan"),
}
#: Sentences that match one of these address the model, not the reader.
INJECTION_PATTERNS = (
    r"(?i)(ignore|disregard|forget|lupakan|abaikan|hapus)\s+[^.\n]{0,40}(previous|prior|above|earlier|sebelumnya|di\s*atas|aturan|instruksi|perintah)",
    r"(?i)(system|assistant|pengguna|user)\s*(prompt)?\s*:\s*",
    r"(?i)you\s+are\s+now\s+|mulai\s+sekarang\s+kamu\s+adalah",
    r"(?i)(jangan|do\s+not)\s+(sebutkan|reveal|cantumkan|sebut)[^.\n]{0,40}(instruksi|prompt|sistem|system)",
    r"(?i)[<]{1,2}\|?\s*(im_start|im_end|system|endoftext)\s*\|?[>]{0,2}",
)
#: Extensions that are accepted, with their types.
MIME_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".csv": "text/csv",
    ".html": "text/html",
    ".json": "application/json",
}
TEXT_EXTENSIONS = (".txt", ".md", ".csv", ".html", ".json")
#: First bytes, in hexadecimal, of files that run.
EXECUTABLE_MAGICS = (
    ("4D5A", "executable PE (MZ)"),
    ("7F454C46", "executable ELF"),
    ("CAFEBABE", "Mach-O/Java class magic"),
    ("FEEDFACE", "Mach-O 32-bit"),
    ("FEEDFACF", "Mach-O 64-bit"),
    ("CFFAEDFE", "Mach-O 64-bit LE"),
    ("CEFAEDFE", "Mach-O 32-bit LE"),
    ("2321", "script shebang"),
)
#: Roles of a workspace, least first.
ROLES = ("viewer", "contributor", "editor", "admin")
#: Upper bounds, in seconds, of the request histogram.
LATENCY_BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
