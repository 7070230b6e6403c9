"""Status vocabularies and other fixed values of the catalog."""

# The photo statuses and the sets that predicates are built from.
DELIVERED = ("Completed", "Copied", "Found_At_Destination")
IN_REJECTS = ("Rejected", "Rejected_Copied")
NOT_ORGANIZED = ("Pending", "Processing", "Failed")
STILL_IN_SOURCE = (*NOT_ORGANIZED, "Copied", "Rejected_Copied")
COPIES = ("Duplicate", "Removed_Duplicate")
OPEN = ("Pending", "Duplicate")
CLOSED = ("Completed", "Copied", "Found_At_Destination", "Processing", "Rejected", "Rejected_Copied", "Rejected_Emptied")
SETTLED = ("Pending", "Copied", "Duplicate", "Rejected_Copied")
ELIGIBLE = {"COPY": ("Pending",), "MOVE": ("Pending", "Copied", "Rejected_Copied")}

# Extensions of pictures that are read directly, and of camera raw formats.
RASTER = ("jpg", "jpeg", "jpe", "jfif", "png", "gif", "bmp", "webp", "tif", "tiff", "heic", "heif", "avif")
RAW = ("raw", "dng", "cr2", "cr3", "crw", "nef", "nrw", "arw", "srf", "sr2", "raf", "orf", "rw2", "pef", "ptx", "srw", "erf", "3fr", "fff", "iiq", "mos", "mrw", "x3f")

# Percent thresholds and the largest distances of 64-bit hashes that they permit.
THRESHOLDS = {75: 16, 80: 12, 85: 9, 90: 6, 95: 3, 100: 0}
HASH_BITS = 64

# Orientations that are turned by 0 to 3 quarters, and those that are mirrored as well.
QUARTERS = {1: 0, 6: 1, 3: 2, 8: 3}
MIRRORED = {2: 0, 7: 1, 4: 2, 5: 3}

#: The year below which a date is suspicious unless a setting says otherwise (fixed value), and a frozen "now".
MIN_YEAR = 1800
NOW_YEAR = 2026
