"""Multi-stage plans: feature modules, training pairs, forwarding, models, lineage cuts."""
