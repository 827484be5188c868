"""Logistic and linear (mixed) models on reduced trial tables.

Spark reduces the log to one row per unit; every evaluation of a model is a distributed sum over
those rows. Matrices over many items stay on the cluster as tiles; only sums of the size of the fixed
part, of few items' effects or of a vector of item effects come back to the driver.
"""

from pyspark import cloudpickle

import trialweave

# tasks get the small numeric helpers with the job, executors need no installed copy
cloudpickle.register_pickle_by_value(trialweave)

from .compare import compare_fits
from .design import Factor, Model, Numeric, Random
from .glm import fit_glm
from .glmm import fit_glmm
from .lmm import fit_lmm
from .marginal import marginal_means, pairwise
