"""Fixed pattern tables of the curation rules (Java regular expressions), in the order in which they are tried."""

# Personal-data classes, first match wins.
PERSONAL_DATA = [
    ("email", r"\b[^\s@]+@[^\s@]+\.[A-Za-z]{2,}\b"),
    ("url", r"(?i)(?:https?://|www\.)\S+|\b[A-Za-z0-9.-]+\.(?:com|net|org|io|co)\b"),
    ("phone", r"(?<!\d)(?:\+?1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]\d{3}[\s.-]\d{4}(?!\d)"),
    ("zip", r"(?<!\d)\d{5}(?:-\d{4})?(?!\d)"),
    ("payment_or_secret", r"(?i)\b(?:venmo|zelle|cash\s*app|paypal|routing|account\s*(?:number|#)|pass(?:word|code)|access\s*code|door\s*code|security\s*code)\b"),
    ("unresolved_marker", r"(?s)<[A-Z][A-Z0-9_-]{1,}>|\{\{.*?\}\}"),
]
# Fixed value: wrapper text that no target may hold.
WRAPPER_TEXT = r"(?im)(?:<think>|</think>|as an ai|language model|```|^\s*(?:assistant|owner|taylor)\s*:\s*)"
SPEAKER_PREFIX = r"(?i)^\s*(?:assistant|owner|taylor)\s*:\s*"
# Claims and actions that a reply may not make without a verified state.
IDENTITY_CLAIM = r"(?i)\b(?:i(?:'m| am)\s+(?:a\s+)?(?:real\s+)?(?:person|human)|i(?:'m| am)\s+not\s+(?:a\s+)?(?:bot|ai|language model))\b"
UNSUPPORTED_ACTION = (
    r"(?i)(?:\bon my way\b|\beta\b|\bi(?:'m| am) arriving\b|\bi(?:'ll| will) be there\b|\bi(?:'ve| have) scheduled\b|"
    r"\b(?:is|was|has been|will be)\s+(?:booked|scheduled|confirmed)\b|\b(?:i(?:'ll| will)|i can|we(?:'ll| will)|we can)\s+put (?:you|me) down\b|"
    r"\bput you on (?:the )?calendar\b|\b(?:i(?:'ll| will)|i can|we(?:'ll| will)|we can)\s+(?:book you in|book|schedule|confirm)\b|"
    r"\b(?:i(?:'ll| will)|i can|we(?:'ll| will)|we can)\s+(?:mark|update)\b.{0,40}\b(?:availability|calendar|appointment)\b|"
    r"\b(?:i can|we can)\s+(?:add|put)\b.{0,40}\bcalendar\b|\bi have (?:an? )?(?:slot|opening)\b|"
    r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\s+(?:at|morning|afternoon|evening)\b|\bi(?:'m| am| will)\s+(?:not\s+)?be\s+coming\b)"
)
EXTERNAL_ACTION = (
    r"(?i)\b(?:i(?:'ll| will)|i can|i(?:'ve| have)|we(?:'ll| will)|we can|we(?:'ve| have))\s+(?:not\s+)?"
    r"(?:send|text|email|call|message|confirm|confirm back|send an update|send a confirmation|put you on|book|schedule)\b"
)
SERVICE_LEAKAGE = (
    r"(?i)\b(?:appointment|schedule|reschedule|calendar|invoice|quote|customer|address|service|arrival|availability|booking|book|window|windows|"
    r"cleaning|cleaner|housekeeping|date|time|morning|afternoon|evening)\b"
)
PRICED_TOTAL = r"(?i)(?:invoice|total|charge|price).{0,30}\$\s?\d"
AMOUNT = r"(?:\$\s?\d|\b\d+\.\d{2}\b)"
# Signals of a conversation's mode.
GENERAL_SIGNAL = r"(?i)\b(?:what|why|how|when|where|who|explain|tell me|story|trivia|example|define|meaning|difference|capital|summarize|write|create|favorite)\b|[?]"
BUSINESS_SIGNAL = (
    r"(?i)\b(?:appointment|schedule|reschedule|calendar|invoice|quote|service|job|work|visit|repair|estimate|availability|price|payment|customer|booking|book|"
    r"window|windows|cleaning|cleaner|housekeeping)\b"
)
TIME_SIGNAL = (
    r"(?i)\b(?:january|february|march|april|may|june|july|august|september|october|november|december|monday|tuesday|wednesday|thursday|friday|saturday|sunday|"
    r"today|tomorrow|tonight|next week|this week|date|day|time|morning|afternoon|evening|noon|\d{1,2}(?::\d{2})?\s*(?:a\.?m\.?|p\.?m\.?)|\d{1,2}(?:st|nd|rd|th)\b)"
)
CASUAL_SIGNAL = r"(?i)\b(?:actually|by the way|speaking of|on another note|random question|my dog|my cat|funny story|unrelated)\b"
# Fixed value: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
