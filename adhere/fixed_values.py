"""Values that results depend on; they are data, not tuning."""

# The default routine offered to an owner without a template.
# (title, day type, planned start, planned end, category, position)
DEFAULT_ROUTINE = [
    ("Wake & morning routine", "weekday", "07:30", "08:30", "rest", 1),
    ("Deep focus block 1", "weekday", "08:30", "12:30", "focus", 2),
    ("Lunch & reset", "weekday", "12:30", "13:30", "rest", 3),
    ("Deep focus block 2", "weekday", "13:30", "16:30", "focus", 4),
    ("Exercise", "weekday", "16:30", "17:30", "move", 5),
    ("Dinner & wind down", "weekday", "17:30", "19:00", "rest", 6),
    ("Free / personal time", "weekday", "19:00", "22:30", "rest", 7),
    ("Slow morning", "weekend", "08:00", "09:00", "rest", 1),
    ("Make-up / longer exercise", "weekend", "09:00", "10:30", "move", 2),
    ("Optional catch-up work", "weekend", "10:30", "13:00", "focus", 3),
    ("Free / errands / rest", "weekend", "13:00", "18:00", "rest", 4),
]

# The 30 characters a share code may hold, and its length.
CODE_ALPHABET = "ABCDEFGHJKMNPQRSTUVWXYZ2345678"
CODE_LENGTH = 6

# The allowed values of the enumerated columns.
DAY_TYPES = ("weekday", "weekend")
PERIOD_TYPES = ("daily", "weekly", "monthly")
GOAL_PERIODS = ("weekly", "monthly")
GOAL_METRICS = ("hours", "count")
PERMISSIONS = ("view", "edit")

# Defaults for missing input.
DEFAULT_CATEGORY = "rest"
DEFAULT_PERMISSION = "view"
UNKNOWN_PERSON = "Someone"
MISSING_TIME = "—"
