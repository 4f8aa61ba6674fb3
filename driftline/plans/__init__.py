"""Multi-step plans: detection, paths, mapping, tomography, publishing."""
