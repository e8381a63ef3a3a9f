from . import drift, incidents, lineage, monitor, ordered, profile, quantiles, risk, selection, skew, triage
