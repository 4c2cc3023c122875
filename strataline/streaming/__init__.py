"""Incremental work is content-addressed batch (strataline.plans.incremental): files change in place, and a stream source would only see new paths."""
