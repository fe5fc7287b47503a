"""driftline.plans"""
