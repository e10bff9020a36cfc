"""Parameters of the stand-in scenario over the supplied tables (events spans 30 days)."""

# Fixed values of the stand-in scenario.
HORIZON = 7                                  # label horizon in days (events cover one month)
TRAIN = ("2024-01-01", "2024-01-15")         # half-open day ranges
VAL = ("2024-01-15", "2024-01-22")
TEST = ("2024-01-22", "2024-01-31")
TAGS_END = "2024-01-31"
SEED = 2019
PER_GROUP = 2
K_BINS = 10
N_ROUNDS = 10
ROUND = 5                                    # the paced round shown by the bin queries
SCORE_SCALE = 50.0                           # closed-form score p = x / (x + scale)
SWEEP = [0.44, 0.445, 0.45, 0.455, 0.46, 0.465, 0.47, 0.475, 0.48]
THRESH_HI, THRESH_LO, THRESH_BEGIN, THRESH_DAYS = 0.6, 0.5, "2024-01-01", 30
HIST_BINS = 100
BIT_OVER, BIT_ROUNDS, BIT_THRESHOLD = 60.0, 3, 0.5   # binarised metrics of the naive Bayes ensemble
