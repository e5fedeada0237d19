"""Fixed values. Each must keep exactly this value for results to agree with existing files."""

# Degrees to radians, as used by the view-distance formula.
VIEW_DEGREE = 0.01745329251

# Histogram limits of the two wrapped viewing angles, in radians.
ROT_LIMIT = 3.1415926535
TILT_LIMIT = 1.570796

# Electron wavelength: WAVELENGTH / sqrt(V * (1 + V * RELATIVISTIC)), V in volts.
WAVELENGTH = 12.2643247
RELATIVISTIC = 0.978466e-6

# Unit of the spherical aberration in the unit of lengths.
ANGSTROM_PER_MM = 1e7

# Largest amplitude contrast that still has a finite phase.
MAX_AMPLITUDE_CONTRAST = 0.999999

# Step-name prefixes and the phase they belong to, most specific first.
STEP_PHASES = [
    ("01_randomize_halves", 1),
    ("02_bootstrap_reconstruct", 1),
    ("03_score_particles", 2),
    ("04_", 3),
    ("05_", 3),
    ("06_", 4),
    ("07_", 4),
    ("08_", 4),
]

# Words read as true, in any case.
TRUE_WORDS = ["true", "t", "yes", "y", "1", "on"]

# Optics columns of a master particle table, in file order.
OPTICS_COLUMNS = [
    "_rlnOpticsGroup",
    "_rlnOpticsGroupName",
    "_rlnTomoTiltSeriesPixelSize",
    "_rlnVoltage",
    "_rlnSphericalAberration",
    "_rlnAmplitudeContrast",
]

# Pixel types of a binary stack by mode number.
STACK_MODES = {0: "int8", 1: "int16", 2: "float32", 6: "uint16", 12: "float16"}
