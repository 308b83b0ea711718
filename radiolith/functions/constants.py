"""Fixed values of the imaging domain."""

# The twelve finding labels in order, and the numbers of planes.
LABELS = ["ACL", "MCL", "Medial Meniscus", "Lateral Meniscus", "Medial OA", "Lateral OA", "PF OA", "Effusion", "Synovitis", "Baker's", "Contusion", "Fracture"]
PLANE_IDS = {"Unknown": 0, "Sagittal": 1, "Coronal": 2, "Axial": 3}

# Parts of manufacturer names and the vendor families they stand for, in order of precedence.
VENDOR_FAMILIES = [("siemens", "Siemens"), ("philips", "Philips"), ("ge medical", "GE"), ("gehc", "GE"), ("toshiba", "Canon/Toshiba"), ("canon", "Canon/Toshiba"), ("fujifilm", "Fujifilm/Hitachi"), ("hitachi", "Fujifilm/Hitachi")]
