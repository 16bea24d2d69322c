"""Fixed values that results depend on: word lists, extension buckets, phrases, rules."""

from __future__ import annotations

# Extension buckets.
IMAGE_EXTS = "jpg jpeg png webp gif bmp tif tiff heic heif avif".split()
VIDEO_EXTS = "mp4 mov webm mkv avi m4v".split()
AUDIO_EXTS = "mp3 wav flac m4a ogg aac".split()
DOC_EXTS = "pdf txt md markdown rtf json csv log yaml yml toml xml doc docx odt pages tex".split()
DESIGN_EXTS = "psd ai fig sketch xd afdesign svg indd eps".split()
ARCHIVE_EXTS = "zip rar 7z tar gz bz2 xz dmg iso".split()
PROCESSABLE_EXTS = (
    "jpg jpeg png webp gif bmp tif tiff heic heif avif mp4 mov webm mkv m4v pdf txt md markdown json csv log yaml yml "
    "toml xml rtf"
).split()
CAPTURE_STARTS = ["screenshot", "screen shot", "capture", "snip", "cleanshot"]

# Media types.
MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif",
    "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "heic": "image/heic", "heif": "image/heic",
    "avif": "image/avif", "svg": "image/svg+xml", "mp4": "video/mp4", "m4v": "video/mp4", "mov": "video/quicktime",
    "webm": "video/webm", "mkv": "video/x-matroska", "avi": "video/x-msvideo", "mp3": "audio/mpeg", "wav": "audio/wav",
    "flac": "audio/flac", "m4a": "audio/mp4", "ogg": "audio/ogg", "aac": "audio/aac", "pdf": "application/pdf",
    "txt": "text/plain", "log": "text/plain", "md": "text/markdown", "markdown": "text/markdown",
    "json": "application/json", "csv": "text/csv", "yaml": "application/yaml", "yml": "application/yaml",
    "toml": "application/toml", "xml": "application/xml", "rtf": "application/rtf", "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "zip": "application/zip",
    "rar": "application/vnd.rar", "7z": "application/x-7z-compressed", "tar": "application/x-tar",
    "gz": "application/gzip", "psd": "image/vnd.adobe.photoshop", "ai": "application/postscript",
    "fig": "application/figma", "sketch": "application/sketch", "dmg": "application/x-apple-diskimage",
    "iso": "application/x-iso9660-image",
}
MIME_OTHER = "application/octet-stream"

# Query words.
KINDS = "photo screenshot document video audio design archive other".split()
KIND_WORDS = {
    "screenshot": "screenshot", "screenshots": "screenshot", "screengrab": "screenshot", "screengrabs": "screenshot",
    "capture": "screenshot", "captures": "screenshot", "video": "video", "videos": "video", "clip": "video",
    "clips": "video", "recording": "video", "recordings": "video", "audio": "audio", "voice": "audio",
    "pdf": "document", "pdfs": "document", "document": "document", "documents": "document", "doc": "document",
    "docs": "document", "design": "design", "designs": "design", "mockup": "design", "mockups": "design",
    "figma": "design", "archive": "archive", "zip": "archive",
}
DAY_PHRASES = {
    "today": 1, "this morning": 1, "tonight": 1, "yesterday": 2, "this week": 7, "last week": 7, "past week": 7,
    "this month": 30, "last month": 30, "past month": 30, "this year": 365, "last year": 365, "recently": 14, "recent": 14,
}
DATE_WORDS = "today tonight yesterday morning last this past week month year recent recently".split()
STOP_WORDS = (
    "a about all an and any are as at be been by can could did do does find for from get give had has have i in is it "
    "its just like me my of on or our please show some that the their them then there these they this those to up us "
    "was we were what when where which who will with would you your"
).split()

# Words of described queries. Kind words that also begin a sentence are soft: beside other words they say nothing.
DESCRIBED_KINDS = {
    "photo": "photo", "photos": "photo", "photograph": "photo", "photographs": "photo", "image": "photo", "images": "photo",
    "picture": "photo", "pictures": "photo", "pic": "photo", "pics": "photo", "screenshot": "screenshot",
    "screenshots": "screenshot", "screengrab": "screenshot", "document": "document", "documents": "document", "doc": "document",
    "docs": "document", "pdf": "document", "video": "video", "videos": "video", "clip": "video", "clips": "video",
    "movie": "video", "footage": "video", "audio": "audio", "sound": "audio", "sounds": "audio", "music": "audio",
    "song": "audio", "songs": "audio", "recording": "audio", "design": "design", "designs": "design", "mockup": "design",
    "sketch": "design", "archive": "archive", "archives": "archive", "zip": "archive",
}
SOFT_KIND_WORDS = "photo photos photograph photographs image images picture pictures pic pics".split()
DESCRIBED_DAYS = {
    "this morning": 1, "this evening": 1, "last night": 2, "the other day": 3, "last week": 7, "this week": 7, "past week": 7,
    "last month": 30, "this month": 30, "past month": 30, "last year": 365, "this year": 365, "past year": 365, "today": 1,
    "tonight": 1, "yesterday": 2, "recently": 14, "recent": 14,
}
DESCRIBED_DATE_WORDS = "today tonight yesterday morning evening night other day last this past week month year recent recently".split()
DESCRIBED_STOP_WORDS = (
    "a about above after again against all also am an and any are around as at be because been being below beside between beyond "
    "but by can could d did do does doing down during each find for from get give had has have having he her here hers him his how i "
    "if in into is it its just like ll look looking m may me might mine must my near next no nor not of off on onto or our ours out "
    "over own please re s same search she should show so some still such t than that the their theirs them then there these they "
    "this those through to too under until up upon us ve very was we were what when where which while who whom why will with within "
    "without would you your yours"
).split()

# Words that mean the same.
SYNONYMS = [
    "motorcycle motorbike bike scooter moped", "car automobile sedan van", "bicycle cycle bike", "sofa couch settee",
    "dog puppy pup", "cat kitten", "child kid baby toddler", "person people man woman guy girl boy someone face",
    "phone smartphone mobile iphone android", "laptop notebook macbook computer desktop", "screen monitor display",
    "hoodie hoody sweatshirt", "jacket coat", "shirt tshirt tee", "trousers pants jeans", "shoe sneaker trainer boot",
    "table desk", "chair seat stool", "building house architecture home", "mountain hill peak",
    "beach shore seaside coast", "water sea ocean lake river", "tree forest woods", "sunset sundown dusk sunrise dawn",
    "rain rainy raining downpour wet", "street road avenue highway", "food meal dinner lunch breakfast",
    "coffee espresso cappuccino latte", "text writing words", "paper document form", "window glass", "flower plant",
    "rug carpet mat", "bag backpack rucksack handbag", "glasses spectacles", "wedding bride groom",
    "party celebration birthday",
]

# What a text or a name must contain for a tag.
SIGNALS = {
    "react": ["react", "usestate", "useeffect", "usememo", "jsx", "next.js", "nextjs"],
    "typescript": ["typescript", "tsx", ": string", ": number", ": boolean", "interface i"],
    "javascript": ["javascript", "console.log", "=>", "const ", "let ", "document.getelementbyid"],
    "python": ["python", "traceback (most recent call last)", "def ", "self.", "__init__", "pip install"],
    "rust": ["cargo", "unwrap()", "impl ", "&str", "fn main", "rustc"],
    "java": ["public static void", "system.out.print", "import java"],
    "sql": ["select ", "insert into", "update set", "left join", "create table"],
    "css": ["display: flex", "border-radius", "background-color", "margin:", "font-size"],
    "html": ["<!doctype html", "<div", "<html", "&lt;div"],
    "shell": ["$ ", "npm run", "yarn ", "git commit", "sudo ", "chmod ", "powershell"],
    "error": ["error", "exception", "traceback", "failed", "failure", "syntaxerror", "undefined is not", "panic", "stack trace"],
    "terminal": ["command prompt", "powershell", "bash$", "c:\\users", "~$", "zsh"],
    "code": ["function ", "class ", "return ", "const ", "def ", "import ", "package ", "module "],
    "receipt": ["receipt", "invoice", "subtotal", "total due", "vat", "amount paid", "order #"],
    "invoice": ["invoice number", "invoice date", "bill to", "purchase order"],
    "chart": ["chart", "graph", "axis", "legend", "% of"],
    "dashboard": ["dashboard", "analytics", "overview", "metrics", "kpi"],
    "login": ["sign in", "log in", "password", "forgot password", "two-factor"],
    "form": ["submit", "required field", "please enter", "first name", "last name"],
    "ui": ["button", "toolbar", "sidebar", "dropdown", "modal", "menu bar"],
    "design": ["figma", "mockup", "wireframe", "artboard", "prototype"],
    "presentation": ["slide", "agenda", "keynote", "powerpoint"],
    "spreadsheet": ["budget", "spreadsheet", "sheet1", "pivot table"],
    "recipe": ["recipe", "ingredients", "preheat", "tablespoon", "bake"],
    "ticket": ["boarding pass", "seat ", "gate ", "admits one", "booking reference"],
}
CONTAINER_LABELS = ["photo", "image", "picture", "scene"]
KIND_TAGS = ["screenshot", "document", "video", "audio", "design", "archive"]

# Names that folders can't have.
RESERVED = ["CON", "PRN", "AUX", "NUL"] + [f"{p}{n}" for p in ("COM", "LPT") for n in range(1, 10)]

# Letters with marks and the plain ones they are read as.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
