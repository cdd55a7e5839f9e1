"""Fixed values of the operators' semantics: formats, word lists, symbol tables, patterns and limits."""

from __future__ import annotations

# Format of a file by its lower-case extension.
FORMATS = {
    ".txt": "text", ".md": "text", ".py": "text", ".sh": "text", ".log": "text", ".rst": "text",
    ".json": "json", ".csv": "csv", ".yaml": "yaml", ".yml": "yaml", ".pdf": "pdf",
    ".docx": "word", ".doc": "word", ".xlsx": "excel", ".xls": "excel", ".pptx": "ppt", ".ppt": "ppt",
    ".html": "html", ".htm": "html", ".zip": "zip",
}

# Media type of an image by its lower-case extension; others are image/jpeg.
IMAGE_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp"}

# Characters for glyph codes, in the order of replacement.
CID_CHARACTERS = {16: "〈", 17: "〉", 40: "(", 41: ")", 91: "[", 93: "]", 123: "{", 125: "}", 60: "<", 62: ">", 34: '"', 39: "'", 44: ",", 46: ".", 58: ":", 59: ";", 61: "=", 43: "+", 45: "-", 42: "*", 47: "/", 92: "\\", 124: "|"}

# Commands of Greek letters, in the order of replacement.
GREEK = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "iota": "ι",
    "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "upsilon": "υ",
    "phi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Alpha": "Α", "Beta": "Β", "Gamma": "Γ", "Delta": "Δ", "Epsilon": "Ε", "Zeta": "Ζ", "Eta": "Η", "Theta": "Θ", "Iota": "Ι",
    "Kappa": "Κ", "Lambda": "Λ", "Mu": "Μ", "Nu": "Ν", "Xi": "Ξ", "Pi": "Π", "Rho": "Ρ", "Sigma": "Σ", "Tau": "Τ", "Upsilon": "Υ",
    "Phi": "Φ", "Chi": "Χ", "Psi": "Ψ", "Omega": "Ω",
}

# Mathematical commands, in the order of replacement (a shorter name may come before a longer one).
MATH = {
    "times": "×", "div": "÷", "pm": "±", "mp": "∓", "leq": "≤", "geq": "≥", "neq": "≠", "approx": "≈", "equiv": "≡", "propto": "∝",
    "infty": "∞", "partial": "∂", "nabla": "∇", "cdot": "·", "cdots": "⋯", "vdots": "⋮", "ddots": "⋱", "int": "∫", "sum": "∑", "prod": "∏",
    "cup": "∪", "cap": "∩", "in": "∈", "notin": "∉", "subset": "⊂", "supset": "⊃", "subseteq": "⊆", "supseteq": "⊇", "emptyset": "∅",
    "forall": "∀", "exists": "∃", "neg": "¬", "wedge": "∧", "vee": "∨", "rightarrow": "→", "leftarrow": "←", "Rightarrow": "⇒",
    "Leftarrow": "⇐", "Leftrightarrow": "⇔",
}

# Chapter headings, in the order in which they are tried.
CHAPTER_PATTERNS = [
    r"(?m)^(?:Chapter|CHAPTER|Ch\.)\s+(\d+)",
    r"(?m)^第\s*[一二三四五六七八九十百千\d]+\s*章",
    r"(?m)^(?:Part|PART)\s+([IVXLCDM\d]+)",
    r"(?m)^#\s+",
    r"(?m)^##\s+",
]
# Words that are no keywords of a title.
TITLE_STOP_WORDS = ["the", "a", "an", "of", "in", "to", "and", "is", "for", "on", "at", "by", "with"]

# References to figures, headers of page ranges, figure captions, captions of any kind.
FIGURE_REFERENCE = r"(?i)\bFigure\s+(\d+)\b"
CHUNK_HEADER = r"^# .*\(pages\s+(\d+)[–-](\d+)\)\s*$"
FIGURE_CAPTION = r"(?i)^\s*\*{0,2}(?:Figure|Fig\.?)\s+(\d+)\s*[:.\-]\s*(.+?)\s*\*{0,2}\s*$"
CAPTION = r"(?i)^\s*(Fig(?:ure)?\.?|Table|图|表)\s*(S?\d+[A-Za-z]?)\s*[.:：\s]"

# Image files' names.
IMAGE_NAME = r"(?i)page(\d+)_img(\d+)"
IMAGE_KIND = r"(?i)page\d+_img\d+_([a-zA-Z0-9_]+)\."

# Metadata keys that a document keeps, in the order of the front matter.
METADATA_KEYS = ["title", "author", "subject", "keywords", "created_at", "modified_at"]

# Limits and thresholds.
CONTENT_LIMIT, ZIP_MEMBER_LIMIT, TRUNCATED = 200_000, 50_000, "\n... [Content truncated]"
SPLIT_PAGES, BATCH_PAGES, OVERLAP_PAGES, OVERLAP_LINES, OPEN_END = 30, 64, 2, 40, 2**31 - 1
SAMPLE_PAGES, PREVIEW_CHARS, PREVIEW_PAGES, SCAN_CHARS = 10, 300, 30, 500
NEAR_DUPLICATE_BITS, CANDIDATES_KEPT = 8, 3
REGION_TYPES = ["image", "chart", "table", "formula", "unknown"]
DECISION_STATES = ["confirmed", "corrected", "ambiguous"]

#: Line breaks of str.splitlines().
LINE_BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"

# Form fields by their code, and the metadata of a PDF file.
FIELD_TYPES = {1: "button", 2: "checkbox", 3: "combobox", 4: "listbox", 5: "radio", 7: "text"}
PDF_METADATA = ["title", "author", "subject", "keywords", "creator", "producer", "creation_date", "modification_date"]

# Least width, height and area of a region, and of a fallback cluster; points by which a region grows.
LEAST_SIDE, LEAST_AREA, LEAST_CLUSTER, MARGIN = 12.0, 144.0, 400.0, 3.0

# What a summary of a run shows.
SUMMARY = [
    "error", "output_directory", "backend_used", "files", "warnings", "chunk_count", "chunk_success_count", "chunk_failure_count", "all_chunks_failed", "quality_state", "quality_metrics",
    "requires_ocr", "toc_confidence", "toc_resolution_mode", "resolved_start_page", "resolved_end_page", "resolved_page_map", "image_count", "saved_path", "provenance", "models_ready",
    "readiness", "inference_verified", "config_path", "packages", "model_paths", "missing", "offline", "manifest_path", "visual_review",
]
