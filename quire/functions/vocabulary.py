"""Fixed values, all of this module: the words that a scene's facets may take, and the gates' settings."""

TONES = [
    "dread", "terror", "anxiety", "menace", "rage", "defiance", "disgust", "contempt",
    "grief", "melancholy", "despair", "loneliness", "shame", "guilt", "regret", "resignation",
    "joy", "delight", "excitement", "triumph", "hope", "passion", "amusement", "wonder",
    "serenity", "contentment", "tenderness", "affection", "relief", "gratitude", "compassion", "pride",
    "surprise", "suspense", "curiosity", "awe",
    "bittersweet", "nostalgia", "longing", "foreboding", "irony", "satire", "whimsy", "solemnity",
]
INTENSITIES = ["low", "moderate", "high"]
ARCS = ["rising", "steady", "falling", "turn"]
PARAGRAPH_TYPES = ["scene", "noise"]
CONTENT_FORMS = ["prose", "other", "noise"]
STITCH_STATES = ["complete", "stitched", "broken_stitch"]
RIGHTS = "Public domain in the USA."
DRAMA_WORDS = ["poems", "poetry", "plays", "drama"]
OTHER_SHARE = 0.70
MIN_SEGMENT_CHARS = 200
CHUNK_CHARS = 30_000
BATCH_CHARS = 12_000
LOOKBACK = 3
N_DESCRIPTORS = 5
SCHEMA_VERSION = 1
FILTERS = [
    "scene_id", "book_id", "author", "language", "dominant_tone", "prev_tone", "next_tone",
    "intensity", "arc", "stitch_status", "enriched",
]
#: What stands before a sentence that is searched for.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
#: Retries: the longest pause in seconds, and how often a model is asked.
BACKOFF_CAP = 30
ATTEMPTS = 10
#: Calls of a model that a task makes at a time.
THREADS = 6
